"""What every operator needs from the session: tables, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hand only when its measured size stays below this.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds more than one in so many of all rows; so there are at most as many hot keys.
HOT_SHARE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (file or folder) below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session whose executors are this very process (tests, bench) may do without; it gets a folder that is
    removed at exit. A cluster without a named folder is an error: a folder of one machine would not survive it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
        return
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    own = tempfile.mkdtemp(prefix="vellum-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors; what is cut already stays."""
    if getattr(df, "_vellum_cut", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._vellum_cut = True
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _table_root(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/vellum-tables"


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the checkpoint folder: for large sides, compressed and read by column.

    Its size is that of its files, where a checkpoint keeps its plan's estimate. The tables of a session lie in one
    folder; ``release`` removes them.
    """
    path = f"{_table_root(df.sparkSession)}/{uuid.uuid4().hex}"
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vellum_cut = True
    return out


def release(spark: SparkSession) -> None:
    """Remove the stored tables of the session; frames that read them must not be used any more."""
    _delete(spark, _table_root(spark))


class Shelf:
    """Stored tables for loops: those that a later round replaces are dropped at once.

    A checkpoint keeps its plan's size estimate; estimates of joins multiply, so that after some rounds planning alone
    takes minutes. A table that is written and read again has the size of its files.
    """

    def __init__(self, spark: SparkSession, codec: str | None = None):
        self.spark, self.options = spark, {"compression": codec} if codec else {}
        self.root = f"{_table_root(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        with _shuffles_freed(self.spark):
            df.write.parquet(path, **self.options)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                _delete(self.spark, path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``limit`` rows; larger sides keep the planner's shuffle join.

    The side is cut first, so that counting and joining do not compute it twice.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept


def join_facts(rows: DataFrame, facts: DataFrame, key: str, limit: int = BROADCAST_ROWS, computed: bool = False) -> DataFrame:
    """Left join of many rows per key with at most one row of facts per key, without a hot key in one task.

    Few facts are broadcast. Else the keys that hold more than one row in ``HOT_SHARE`` of all, at most ``HOT_SHARE`` of
    them, take theirs by broadcast and all others by shuffle. ``computed`` says that the facts only read a stored table.
    """
    facts = facts if computed else cut(facts)
    if facts.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(facts), key, "left")
    counts = cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") > max(1, total // HOT_SHARE)).select(key, F.lit(True).alias("_hot")))
    marked = rows.join(hot, key, "left")
    few = F.broadcast(facts.join(hot.select(key), key, "left_semi"))
    often = marked.where("_hot").drop("_hot").join(few, key, "left")
    return often.unionByName(marked.where("_hot IS NULL").drop("_hot").join(facts, key, "left"))


def local_session(app: str = "vellum", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
