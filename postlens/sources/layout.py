"""How input is spread over tasks, and where intermediate results are settled."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES_PER_CORE = 16 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: str | list[str]) -> int:
    """Size of the files on disk; reads file listings only, no content."""
    files = spark.read.format("binaryFile").load(paths)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def spread_small(rows: DataFrame, paths: str | list[str]) -> DataFrame:
    """Spread a small input over all cores; leave a large one as its files are.

    A file with a single row group, or a gzip file, is read by one task. If the whole input is
    smaller than a modest share per core, moving it costs little and lets every core take part.
    Larger inputs bring enough splits of their own and are not shuffled.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if input_bytes(spark, paths) < cores * BYTES_PER_CORE:
        return rows.repartition(cores * 2)
    return rows


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="postlens-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(rows: DataFrame) -> DataFrame:
    """Like ``settled`` for wide results: Parquet in the same folder, of which columns can be read."""
    path = f"{checkpoint_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def settled(rows: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and continue from there.

    Used for results that several later steps read: they are computed once, survive the loss
    of executors, and keep the plans of the later steps short.
    """
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def together(*jobs: Callable[[], None]) -> None:
    """Run independent jobs at the same time, so that small ones do not leave the cluster idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


# Up to this many narrow rows (keys, names, counts) go to every task instead of a shuffle.
SMALL_ROWS = 200_000


def broadcast_if_small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast after counting it (up to the limit).

    A larger one is left alone, so that the join shuffles and skewed keys are split at run
    time. Pass settled or stored rows, which are cheap to count.
    """
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows
