"""What the operators of this subpackage share: tables, the shared folder, lineage cuts, bounded batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own on a single
    machine (tests), and an error on a cluster, whose machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if there.isDefined():
            return there.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="verdex-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies under a path of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: later reads don't recompute it and survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the bytes of a text or list column stay near `most` in each; a longer text stands alone.

    Bounds the memory of vectorised code: a text is never split, so the bound is the longest text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        length = pa.compute.list_value_length if pa.types.is_list(col.type) else pa.compute.binary_length
        sizes = pa.compute.fill_null(length(col), 0).to_numpy(zero_copy_only=False) * (4 if pa.types.is_list(col.type) else 1)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        yield batch.slice(at)


def carry_back(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined with the one row that `groups` has for their key; `count` says how many of all `total` rows have it.

    Keys with over 1/share of the rows number under `share`, a bound by counting, so they are broadcast; the others meet in
    a sort-merge join in which no key holds more than that share.
    """
    least = total // share + 1
    hot = F.broadcast(groups.filter(F.col(count) > least))
    rest = groups.filter(F.col(count) <= least).hint("merge")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))


def lowered(col: pa.Array) -> pa.Array:
    """A string array in lower case, letters beyond ASCII included."""
    return pa.compute.utf8_lower(col)
