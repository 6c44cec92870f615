"""Sources and sinks of items: JSON lines, strict and tolerant, directories with lineage, optional files, splits, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """SRC-01, SRC-02, SRC-04: JSON lines; strict fails at a bad line, else bad lines are left out (bad_lines() counts them).

    Which lines are bad doesn't depend on the columns that a query reads, as each line is parsed as a whole.
    """
    paths = [paths] if isinstance(paths, str) else paths
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    parsed = F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(paths).filter(F.trim("value") != "").select(parsed.alias("r")).filter("r IS NOT NULL AND r._bad IS NULL")
    return rows.select(*(F.col(f"r.`{f.name}`") for f in kind.fields))


def read_layered(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, key: str = "id") -> DataFrame:
    """SRC-04: JSON lines of several paths (a list, or one text with commas between), of which a later one overrides an earlier
    one: of each key the last line of the last path that has it. Bad lines are left out; a null key is a key."""
    listed = [p for p in paths.split(",") if p] if isinstance(paths, str) else paths
    out = None
    for k, path in enumerate(listed):
        one = read_jsonl(spark, path, schema, False).withColumn("_at", F.struct(F.lit(k).alias("path"), F.monotonically_increasing_id().alias("line")))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], schema)
    columns = [c for c in out.columns if c != "_at"]
    last = out.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("_at")).alias("_last"))
    return last.select(*(F.col(f"_last.`{c}`").alias(c) for c in columns))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """AGG-08: how many lines of a file aren't JSON objects."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.try_parse_json("value").isNull().alias("bad")).agg(F.count_if("bad").alias("invalid_json"))


def read_directory(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """SRC-03: all files of a directory tree, with the file's name, its config and split from the path, and its rank in lexical order."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    df = df.withColumn("config", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).withColumn("split", F.regexp_extract("file", r"([^/.]+)[^/]*$", 1))
    names = sorted(df.inputFiles())  # the driver has listed them for the scan
    plain = lambda x: F.regexp_replace(x, "^([a-z0-9]+:)/+", "$1/")  # noqa: E731  the two are written with one slash or three
    ranks = spark.createDataFrame([(f, k) for k, f in enumerate(names, 1)], "name string, file_rank int").select(plain("name").alias("name"), "file_rank")
    return df.join(F.broadcast(ranks), plain("file") == F.col("name")).drop("name")


def read_optional(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """SRC-05: an empty relation where there is no such file, asked of the file system that holds the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """SRC-06: one JSON document over many lines."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: each file of a tree as one text, with its name."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("*", F.col("_metadata.file_path").alias("file"))


def read_needles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: the non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("needle")).filter("needle <> ''")


def generate_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """SRC-14: n rows with uniform numbers that depend on the seed and row alone, whatever the partitions."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(1 << 31)) / float(1 << 31)
    return spark.range(n).select("id", u(0).alias("u0"), u(1).alias("u1"), u(2).alias("u2"))


def write_splits(items: DataFrame, path: str) -> None:
    """SNK-01: JSON lines per config and split, in id order inside a file."""
    items.repartition("config", "split").sortWithinPartitions("config", "split", "id").write.mode("overwrite").partitionBy("config", "split").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """SNK-03: a small report as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def fixed_width(df: DataFrame, width: int = 12, rows: int = 100) -> str:
    """SNK-04: the first rows of a report as a table of fixed columns."""
    line = lambda xs: " ".join(str("-" if x is None else round(x, 4) if isinstance(x, float) else x)[:width].rjust(width) for x in xs)
    return "\n".join([line(df.columns), *(line(r) for r in df.take(rows))])
