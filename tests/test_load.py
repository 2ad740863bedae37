"""Import of literal source files: every kind, edge rows, repeated loads."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from postlens.operators import statistics
from postlens.plans.load import load_images, load_posts, read_sources, refresh_statistics
from postlens.schema import POST_COLUMNS
from postlens.sources import images, posts as sources
from postlens.sources.layout import settled
from postlens.sinks import tables

T = 1_510_000_000
RANGE = ("2017-10-27T20:00:00", "2018-11-02T03:59:59")
LOW, HIGH = 1_509_134_400, 1_541_131_199


def gz(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8", newline="") as file:
        file.write(text)


def dump_line(post_id, thread, epoch, body, thumb="N", author="Anon", subject="N"):
    fields = ["N"] * 24
    for no, value in {0: post_id, 2: thread, 4: epoch, 14: thumb, 19: author, 21: subject, 22: body}.items():
        fields[no] = str(value)
    return ",".join(f'"{f}"' for f in fields) + "\n"


@pytest.fixture()
def folders(tmp_path):
    gz(tmp_path / "research/qanon_4chan.csv.gz",
       "thread_id,post_id,author,subject,body,timestamp\n"
       f'1,11,Anon,,">>12\nsecond ""line""",{LOW}\n'
       f"1,12,Anon,s,x >>13,{HIGH}\n"
       f"1,13,Anon,s,too late,{HIGH + 1}\n"
       f'1,14,Anon,s,"text\n>>15",{T}\n'
       "1,15,Anon,s,no time,soon\n")
    gz(tmp_path / "research/qanon_reddit.csv.gz",
       "post_id,parent_id,subreddit,body,timestamp\n"
       f"a1,p1,one,hello,{T}\na2,p2,two,\"x, y\",{T}\n")
    gz(tmp_path / "forum/one_submissions.gz", "\n".join([
        json.dumps({"subreddit": "one", "id": "s1", "created_utc": T, "author": "a", "title": "t",
                    "media": {"type": "v"}, "thumbnail": "self", "url": "u"}),
        json.dumps({"subreddit": "one", "id": "s2", "created_utc": str(T), "author": "a", "title": "t",
                    "media": None, "thumbnail": "self", "url": "u", "parent_id": "x"}),
        '{"subreddit": "one", "id": "s3", broken',
    ]) + "\n")
    gz(tmp_path / "forum/one_comments.gz", "\n".join([
        json.dumps({"subreddit": "one", "id": "c1", "created_utc": T, "author": "a", "body": "ünï 😀",
                    "link_id": "t3_s1", "parent_id": "t1_x"}),
        json.dumps({"subreddit": "one", "id": "c1", "created_utc": T, "author": "z", "body": "again",
                    "link_id": "t3_s1", "parent_id": "t1_x"}),
        json.dumps({"subreddit": "one", "id": "c2", "created_utc": T, "author": "a", "body": "b"}),
    ]) + "\n")
    gz(tmp_path / "board/pol_00.csv.gz",
       dump_line(100, 100, T, r'say \"hi\", ok') + "torn off, line\n"
       + dump_line(101, 100, T, ">>100\\\nsecond\\\nthird", thumb="1s.jpg")
       + dump_line(102, 100, "N", "bad time") + dump_line(104, 100, T, "")
       + dump_line(105, 100, T, r"a\\b \\\"" ))
    gz(tmp_path / "board/pol_01.csv.gz", dump_line(103, 100, T, "x") + dump_line(100, 100, T, "copy"))
    gz(tmp_path / "board/tv.csv.gz", dump_line(100, 100, T, "other board"))
    return {name: str(tmp_path / name) for name in ("research", "forum", "board")}


def by_id(frame):
    return {r.post_id: r for r in frame.collect()}


def test_research_files(spark, folders):
    rows = sources.accepted(read_sources(spark, folders, skip=["forum", "board"], start=RANGE[0], end=RANGE[1]))
    assert rows.columns[:11] == POST_COLUMNS
    got = by_id(rows)
    assert set(got) == {"11", "12", "14", "a1", "a2"}
    assert got["11"].parent_id == "12" and got["11"].body == '>>12\nsecond "line"'
    assert got["11"].subject == "" and got["11"].board == "/pol/"
    assert got["12"].parent_id is None and got["14"].parent_id is None
    assert got["a2"].board == "r/two" and got["a2"].body == "x, y" and got["a2"].parent_id == "p2"
    assert got["a2"].author is None and got["a2"].platform == "q_reddit"


def test_forum_files(spark, folders):
    shaped = read_sources(spark, folders, skip=["research", "board"])
    rows = sources.accepted(shaped).collect()
    got = {(r.post_type, r.post_id, r.author): r for r in rows}
    assert set(got) == {("submission", "s1", "a"), ("submission", "s2", "a"), ("comment", "c1", "a"),
                        ("comment", "c1", "z"), ("comment", "c2", "a")}
    first = got[("submission", "s1", "a")]
    assert json.loads(first.extras)["media"] == {"type": "v"}
    assert json.loads(got[("submission", "s2", "a")].extras)["media"] is None
    assert first.subject == "t" and first.body is None and first.parent_id is None
    assert got[("submission", "s2", "a")].parent_id == "x"
    comment = got[("comment", "c1", "a")]
    assert comment.body == "ünï 😀" and comment.thread_id == "t3_s1" and comment.subject is None
    assert sources.rejected(shaped).count() == 1


def test_board_files(spark, folders):
    shaped = read_sources(spark, folders, skip=["research", "forum"], exclude=["tv.csv.gz"])
    good = sources.accepted(shaped)
    assert {r.board for r in good.collect()} == {"/pol/"}
    got = by_id(good.where("body <> 'copy'"))
    assert set(got) == {"100", "101", "103", "104", "105"}
    assert got["104"].body == "" and got["105"].body == 'a\\b \\"'
    assert got["100"].body == 'say "hi", ok' and got["100"].extras is None
    assert got["101"].body == ">>100\nsecond\nthird" and got["101"].parent_id == "100"
    assert json.loads(got["101"].extras) == {"thumbnail": "1s.jpg"}
    assert got["100"].subject == "N" and got["100"].author == "Anon"
    assert sources.rejected(shaped).count() == 2


def test_skipping_everything_is_an_error(spark, folders):
    with pytest.raises(ValueError):
        read_sources(spark, folders, skip=["research", "forum", "board"])


def test_load_twice_and_more(spark, folders, tmp_path):
    out = str(tmp_path / "out")
    load_posts(spark, folders, out, "first", skip=["board"])
    stored = tables.stored_posts(spark, f"{out}/posts")
    first = {r.post_id: (r.uid, r.author) for r in stored.where("post_type = 'comment'").collect()}
    assert first["c1"][1] == "a"  # the smaller copy wins, whatever the order of tasks
    n = stored.count()
    load_posts(spark, folders, out, "again", skip=["board"])
    assert tables.stored_posts(spark, f"{out}/posts").count() == n
    load_posts(spark, folders, out, "more")
    stored = tables.stored_posts(spark, f"{out}/posts")
    assert stored.count() == n + 6
    assert stored.select("uid").distinct().count() == n + 6
    after = {r.post_id: r.uid for r in stored.where("post_id = 'c1'").collect()}
    assert after["c1"] == first["c1"][0]
    copies = stored.where("post_id = '100' and board = '/pol/'").collect()
    assert [c.body for c in copies] == ['say "hi", ok']  # the earlier file wins
    row = copies[0]
    assert row.dl == 4 and row.month == "2017-11"
    assert row.parent_uid is None and row.thread_uid is None and row.added is not None
    boards = spark.read.parquet(f"{out}/boards").orderBy("uid").collect()
    assert [b.uid for b in boards] == list(range(1, len(boards) + 1))
    assert {b.name for b in boards} == {"/pol/", "/tv/", "r/one", "r/two"}
    known = spark.read.parquet(f"{out}/platforms").select("name").collect()
    assert {r.platform for r in stored.select("platform").distinct().collect()} <= {r.name for r in known}
    assert spark.read.parquet(f"{out}/types").count() == 3
    quarantine = spark.read.parquet(f"{out}/quarantine/more")
    assert quarantine.count() == 4
    partials = tables.stored_statistics(spark, f"{out}/statistics")
    whole = sorted(statistics.partial(stored.drop("dl")).collect())
    assert sorted(statistics.partial(stored).collect()) == whole
    merged = partials.groupBy("platform", "board", "date").agg(F.sum("posts"), F.sum("tokens"))
    assert sorted(merged.collect()) == whole and statistics.corpus(partials)[0] == n + 6
    lost = settled(partials.where("board <> '/tv/'").withColumn("load_id", F.lit("cut")))
    lost.write.mode("overwrite").partitionBy(
        "load_id").parquet(f"{out}/statistics")  # as if the counts of a load were lost
    refresh_statistics(spark, out)
    assert sorted(tables.stored_statistics(spark, f"{out}/statistics").collect()) == whole
    summary = spark.read.json(f"{out}/load_summary/more").where("board = '/tv/'").first()
    assert summary.records == 1 and summary.first_epoch == T


def test_images(spark, tmp_path):
    out = str(tmp_path / "out")
    manifest = tmp_path / "scope_files.xml"
    manifest.write_text(
        '<files><file name="pol-1509.tar.gz" source="original"><size>2147483648</size></file>'
        '<file name="pol-1510.tar.gz"><size>5</size></file><file name="meta.xml"><size>1</size></file></files>')
    thumbs = tmp_path / "thumbs"
    for member in [f"t/1/2/{LOW * 1000}s.jpg", f"t/1/2/{HIGH * 1000 + 999}s.jpg", f"t/1/2/{(HIGH + 1) * 1000}s.jpg",
                   "t/1/readme", "t/1/2/cover.jpg"]:
        path = thumbs / "pol_thumbs" / member
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"jpeg" + member.encode()[-4:])
    for _ in range(2):
        load_images(spark, out, str(manifest), str(thumbs), "https://x/", *RANGE)
    archives = {r.group1: r for r in spark.read.parquet(f"{out}/archives").collect()}
    assert set(archives) == {1509, 1510}
    assert archives[1509].date_from == 1509000000 and archives[1509].date_to == 1509999999
    assert archives[1509].url == "https://x/scope/pol-1509.tar.gz" and archives[1509].board == "/pol/"
    catalogue = spark.read.parquet(f"{out}/images")
    assert {r.image_id for r in catalogue.collect()} == {LOW * 1000, HIGH * 1000 + 999}
    assert catalogue.count() == 2 and {r.thumb_size for r in catalogue.collect()} == {8}
    data = spark.read.parquet(f"{out}/thumbs")
    assert data.count() == 2 and data.where(F.octet_length("data") != 8).count() == 0


def test_bytes_of_other_days_are_not_read(spark, tmp_path):
    """Spark refuses to read a file beyond the limit, so the large files were not read."""
    for second, size in ((LOW, 8), (LOW + 5, 8), (LOW - 1, 5_000), (HIGH + 1, 5_000)):
        path = tmp_path / "pol_thumbs/t/1/2" / f"{second * 1000}s.jpg"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "pol_thumbs/t/1/2/cover.jpg").write_bytes(b"x" * 5_000)
    name = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(name, "100")
    try:
        found = images.thumbnails(images.read_thumbnail_files(spark, str(tmp_path), *RANGE), start=RANGE[0], end=RANGE[1])
        assert sorted(r.image_id for r in found.collect()) == [LOW * 1000, (LOW + 5) * 1000]
        with pytest.raises(Exception, match="exceeds the max length"):
            images.read_thumbnail_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(name)


def test_names_of_header_fields_are_data(spark, tmp_path):
    gz(tmp_path / "b.csv.gz", "thread_id,post_id,author,subject,body,time\n" + f"thread_id,7,a,s,b,{T}\n")
    gz(tmp_path / "f.csv.gz", "post_id,parent_id,subreddit,body,time\n" + f"1,p,subreddit,b,{T}\n2,p,two,b,{T}\n")
    board = sources.accepted(sources.read_posts(spark, "research_board", str(tmp_path / "b.csv.gz")))
    forum = sources.accepted(sources.read_posts(spark, "research_forum", str(tmp_path / "f.csv.gz")))
    assert [(r.post_id, r.thread_id) for r in board.collect()] == [("7", "thread_id")]
    assert sorted(r.board for r in forum.collect()) == ["r/subreddit", "r/two"]


def test_float_times_open_ranges_and_raw_records(spark, tmp_path):
    def line(name, time):
        return f'{{"subreddit":"one","id":"{name}","created_utc":{time},"author":"a","body":"b"}}\n'

    gz(tmp_path / "c.gz", line("f", f"{T}.0") + line("e", f"{T / 1e9}e9") + line("q", f'"{T}"') + line("bad", '"soon"')
       + '{"subreddit": broken\n')
    read = lambda *ends: sources.read_posts(spark, "comments", str(tmp_path / "c.gz"), *ends)
    assert {r.post_id for r in sources.accepted(read()).collect()} == {"f", "e", "q"}
    raw = {r.raw for r in sources.rejected(read()).collect()}
    assert '{"subreddit": broken' in raw and any('"soon"' in r for r in raw) and len(raw) == 2
    assert sources.accepted(read("2030-01-01T00:00:00", None)).count() == 0
    assert sources.accepted(read(None, "2030-01-01T00:00:00")).count() == 3
    assert sources.accepted(read(None, "2010-01-01T00:00:00")).count() == 0
