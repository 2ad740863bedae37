"""CSV files read by splits against Spark's multi-line reader, which reads a file in one task."""

import os
import random

import pytest

from postlens.sources import posts as sources
from postlens.sources import records

T = 1_510_000_000


@pytest.fixture()
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "0")
    yield lambda size: spark.conf.set(names[0], str(size))
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def dump(rng, n, bits, torn):
    out = []
    for k in range(n):
        fields = ["N"] * 23
        fields[0], fields[4] = str(k), str(T)
        fields[22] = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        out.append(",".join(f'"{f}"' for f in fields))
        if rng.random() < 0.05:
            out.append(rng.choice(torn))
    return "\n".join(out)


def both(spark, folder, schema, options, header=False):
    paths = sorted(str(p) for p in folder.iterdir())
    files = [(p, os.path.getsize(p)) for p in paths]
    split = records.read_split_csv(spark, files, schema, options, header)
    whole = sources.read_whole_csv(spark, paths, schema, options, header).select(split.columns)
    return split, sorted(map(tuple, split.collect()), key=str), sorted(map(tuple, whole.collect()), key=str)


@pytest.mark.parametrize("size", [700, 5_000, 40_000, 10_000_000])
def test_dump_splits(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    bits = ["word", "é", "😀", '\\"', "\\\\", "\\\n", "\n", ",", "'", "N", '\\\\\\"', " "]
    torn = ["torn off, line", "x", "", 'torn "odd, line', 'torn "even" line']
    for name, n, end in (("pol_00", 300, ""), ("pol_01", 150, "\n"), ("tv", 1, "\n\n")):
        (tmp_path / f"{name}.csv").write_text(dump(rng, n, bits, torn) + end, encoding="utf-8", newline="")
    (tmp_path / "empty.csv").write_text("")
    small_splits(size)
    split, got, want = both(spark, tmp_path, sources.BOARD_DUMP_RAW, sources.ESCAPED_CSV)
    assert got == want and len(got) > 450
    posts = sources.board_dump_posts(split)
    assert {r.board for r in sources.accepted(posts).collect()} == {"/pol/", "/tv/"}


@pytest.mark.parametrize("size", [300, 4_000, 10_000_000])
def test_doubled_quotes_and_header(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    bits = ["word", '""', "\n", ",", "é", "\\", '""\n""', " "]
    for name in ("a", "b"):
        out = ["thread_id,post_id,author,subject,\"body\nof two lines\",timestamp"]
        for k in range(200):
            body = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
            out.append(f'1,{k},Anon,,"{body}",{T}' if rng.random() < 0.7 else f"1,{k},Anon,s,plain,{T}")
        (tmp_path / f"{name}.csv").write_text("\n".join(out) + "\n", newline="")
    small_splits(size)
    _, got, want = both(spark, tmp_path, sources.RESEARCH_BOARD_RAW, sources.QUOTED_CSV, header=True)
    assert got == want and len(got) == 400


def test_a_record_longer_than_many_splits(spark, tmp_path, small_splits, monkeypatch):
    """Its file is read by one task; the other files are not."""
    monkeypatch.setattr(records, "HEAD_BYTES", 500)
    long = "line\n" * 2_000
    fields = ['"N"'] * 22
    rows = [",".join([f'"{k}"', *fields[1:], f'"{long if k == 3 else "short"}"']) for k in range(8)]
    (tmp_path / "pol_00.csv").write_text("\n".join(rows), newline="")
    (tmp_path / "tv.csv").write_text("\n".join(rows[4:]), newline="")
    small_splits(1_000)
    _, got, want = both(spark, tmp_path, sources.BOARD_DUMP_RAW, sources.ESCAPED_CSV)
    assert got == want and len(got) == 12


def test_carriage_returns_stay_inside_fields(spark, tmp_path, small_splits):
    (tmp_path / "pol.csv").write_text('"1","a\r\nb"\r\n"2","c\r"\r\n', newline="")
    small_splits(6)
    _, got, _ = both(spark, tmp_path, "c0 string, c1 string", sources.ESCAPED_CSV)
    assert [r[:2] for r in got] == [("1", "a\r\nb"), ("2", "c\r")]


def test_a_quote_that_never_closes(spark, tmp_path, small_splits):
    (tmp_path / "pol.csv").write_text('"1","a"\n"2","open\nand on\nand on\n', newline="")
    small_splits(10)
    _, got, want = both(spark, tmp_path, "c0 string, c1 string", sources.ESCAPED_CSV)
    assert [r[0] for r in got] == [r[0] for r in want] == ["1", "2"]


def test_one_plain_dump_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(1)
    path = tmp_path / "pol_00.csv"
    made = dump(rng, 4_000, ["word", "\\\n", '\\"', ","], ["torn"])
    path.write_text(made + "\n" * (8 - len(made) % 8), newline="")
    small_splits(os.path.getsize(path) // 8)
    frame = sources.read_posts(spark, "board_dump", str(path))
    assert frame.rdd.getNumPartitions() == 8
    sizes = frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert min(sizes) > 0.8 * max(sizes) and sum(sizes) > 4_000


def test_groups_of_files(monkeypatch):
    monkeypatch.setattr(records, "GROUP_BYTES", 10)
    files = [("a", 4), ("b", 6), ("c", 1), ("d", 50), ("e", 0)]
    assert records.sized_groups(files) == [["a", "b"], ["c"], ["d"], ["e"]]
