"""Sources and sinks: JSON Lines in three strictness levels, JSON documents, CSV, logs, split folders, small reports.

Readers are lazy and keep projection and filters at the scan where the format has them; sinks use Spark's own commit.
"""

from __future__ import annotations

import html
import json
import os
import re
import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _there(spark: SparkSession, path: str) -> bool:
    """Does a path (or glob) of any file system hold something?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, on_error: str = "fail", missing_ok: bool = False) -> DataFrame:
    """JSON Lines with a schema. on_error: fail, drop (bad lines out) or keep (bad lines in ``_corrupt_record``)."""
    if missing_ok and not _there(spark, path):
        return spark.createDataFrame([], schema)
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[on_error]
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_json_documents(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """One document per file with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).select("*", F.col("_metadata.file_path").alias("path"))


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key in the order, with how many there were (``copies``)."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("copies", F.count("*").over(w))
    return ranked.where("_rn = 1").drop("_rn")


def tail(spark: SparkSession, path: str) -> str | None:
    """The last line of a text file that is not blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = lines.select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).agg(F.max_by("value", F.struct("b", "i")).alias("v")).first()
    return row["v"]


def log_metrics(lines: DataFrame, text: str, order: str, step: str) -> DataFrame:
    """(step, metrics): ``key:number`` pairs of log lines that name the step; escapes are stripped, the last line of a step wins."""
    plain = F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")
    pair = r"([A-Za-z_][A-Za-z0-9_/.-]*):(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    keys, values = F.regexp_extract_all("_l", F.lit(pair), F.lit(1)), F.regexp_extract_all("_l", F.lit(pair), F.lit(2))
    entries = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: F.struct(z["k"].alias("k"), z["v"].cast("double").alias("v")))
    # Of a key said twice in a line, the last counts.
    last = F.aggregate(entries, F.create_map().cast("map<string,double>"), lambda m, z: F.map_concat(F.map_filter(m, lambda k, _: k != z["k"]), F.create_map(z["k"], z["v"])))
    found = lines.withColumn("_l", plain).where(F.col("_l").contains(f"{step}:")).withColumn("metrics", last).withColumn(step, F.try_element_at("metrics", F.lit(step)).cast("bigint"))
    return found.where(F.col(step).isNotNull()).groupBy(step).agg(F.max_by("metrics", F.col(order)).alias("metrics"))


def log_runs(lines: DataFrame, run: str, text: str, order: str, metric: str) -> DataFrame:
    """(run, started, ended, rc, minutes, last): first START and END line of a run, and the last value of a metric.

    Lines without a time, or runs without an END, leave their columns null; one mergeable aggregate over all lines.
    """
    plain = lines.withColumn("_l", F.regexp_replace(text, r"\x1b\[[0-9;]*m", ""))
    start, end = F.regexp_extract("_l", r"^START (.+)$", 1), F.regexp_extract("_l", r"^END (.+) rc=[0-9]+", 1)
    value = F.regexp_extract("_l", re.escape(metric) + r":(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1)
    first = lambda c, x: F.min_by(x, F.when(c, F.col(order)))
    g = plain.groupBy(run).agg(
        first(start != "", start).try_cast("timestamp").alias("started"), first(end != "", end).try_cast("timestamp").alias("ended"),
        first(end != "", F.regexp_extract("_l", r"rc=([0-9]+)", 1)).try_cast("int").alias("rc"), F.max_by(value, F.when(value != "", F.col(order))).try_cast("double").alias("last"),
    )
    return g.withColumn("minutes", F.round(F.timestamp_diff("SECOND", F.col("started"), F.col("ended")) / 60.0, 2))


def imported(rows: DataFrame, old_id: str, parts: Sequence[str]) -> DataFrame:
    """Rows of an older store with their old id and the id this one gives them."""
    key = F.concat(F.lit("ev_"), F.substring(F.sha1(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])), 1, 20))
    return rows.withColumn("old_id", F.col(old_id)).withColumn("new_id", key)


def discovered_runs(spark: SparkSession, root: str, name: str = "train_log.jsonl") -> DataFrame:
    """(run, path) of every folder below ``root`` that holds a log of that name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), "path").distinct()


def write_json_document(rows: DataFrame, path: str) -> None:
    """One small JSON document: the rows as an array; more than 10,000 rows are an error, not a cut."""
    data = [json.loads(r["v"]) for r in rows.select(F.to_json(F.struct("*")).alias("v")).limit(10_001).collect()]
    if len(data) > 10_000:
        raise ValueError("a document of more than 10000 rows")
    spark = rows.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(json.dumps(data, ensure_ascii=False).encode())
    out.close()


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of every *.txt of a folder."""
    files = spark.read.option("wholetext", True).text(f"{folder}/*.txt").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("name"), F.col("value").alias("text"))
    return files.orderBy("name")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON Lines; an append of nothing leaves the target alone."""
    if append and rows.isEmpty():
        return
    rows.write.mode("append" if append else "overwrite").json(path)


def write_csv(rows: DataFrame, path: str, header: Sequence[str]) -> None:
    """CSV with a fixed header; columns that are not there are blank."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in header]).write.mode("overwrite").option("header", True).csv(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """Parquet partitioned by split."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def write_kept_and_dropped(rows: DataFrame, flag: str, path: str) -> None:
    """Two sinks in one pass, as partitions of one write."""
    rows.withColumn("part", F.when(F.col(flag), "kept").otherwise("dropped")).write.mode("overwrite").partitionBy("part").parquet(path)


def markdown_table(rows: DataFrame, limit: int = 200) -> str:
    """A small report; more rows than ``limit`` are an error, not a cut."""
    data = rows.limit(limit + 1).collect()
    if len(data) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in data])


def html_table(rows: DataFrame, limit: int = 200) -> str:
    """As ``markdown_table``, for a browser."""
    data = rows.limit(limit + 1).collect()
    if len(data) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in data) + "</table>"


def copy_sidecars(source: str, target: str, suffixes: Sequence[str] = (".json", ".md")) -> list[str]:
    """Small files beside an index copied to its new version (driver side)."""
    Path(target).mkdir(parents=True, exist_ok=True)
    names = sorted(p.name for p in Path(source).iterdir() if p.is_file() and p.suffix in suffixes)
    for n in names:
        shutil.copy2(Path(source) / n, Path(target) / n)
    return names


def point_latest(root: str, name: str, link: str = "latest") -> str:
    """Flip the ``latest`` link to a version, atomically."""
    fresh = Path(root) / f".{link}.new"
    if fresh.is_symlink():
        fresh.unlink()
    fresh.symlink_to(name)
    os.replace(fresh, Path(root) / link)
    return str(Path(root) / link)
