"""Hostile copies of the test tables: repeated rows, rows of nulls, extra columns with clashing names; and empty tables."""

from pathlib import Path

from pyspark.sql import functions as F

CLASHES = ("k", "p", "w", "c", "r", "s", "text", "source", "side", "group", "edits", "key", "n", "m", "_rn", "chars", "value", "lang_", "seg_no", "band")


def hostile_copy(spark, source: str, target: Path) -> str:
    for path in sorted(Path(source).glob("*.parquet")):
        df = spark.read.parquet(str(path))
        null = spark.createDataFrame([tuple([None] * len(df.columns))], _nullable(df.schema))
        out = df.unionByName(df).unionByName(null).unionByName(null)
        for c in CLASHES:
            if c not in out.columns:
                out = out.withColumn(c, F.lit("clash"))
        out.repartition(3).write.mode("overwrite").parquet(str(target / path.name))
    return str(target)


def empty_copy(spark, source: str, target: Path) -> str:
    for path in sorted(Path(source).glob("*.parquet")):
        spark.read.parquet(str(path)).limit(0).write.mode("overwrite").parquet(str(target / path.name))
    return str(target)


def _nullable(schema):
    import copy

    s = copy.deepcopy(schema)
    for f in s.fields:
        f.nullable = True
    return s


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
