"""SRC-07 to SRC-09: rows out of nested JSON of any shape, by VARIANT: parsed once, exploded along a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(json: Column) -> Column:
    """A VARIANT of a JSON text; null for what is no JSON."""
    return F.try_parse_json(json)


def members(df: DataFrame, variant: str, path: str, prefix: str = "") -> DataFrame:
    """df with a row for each member of the list or object at `path` of its VARIANT column: pos (its place, from 0), key (null in
    a list) and value, a VARIANT; names behind `prefix`. Of anything else, or nothing, at the path there is no row.

    An object's members come in the order of their keys, which is how VARIANT keeps them.
    """
    at = df.withColumn("_at", F.try_variant_get(F.col(variant), path, "variant"))
    names = [f"{prefix}{n}" for n in ("pos", "key", "value")]
    if set(names) & set(df.columns):
        raise ValueError(f"columns {names} are there already; give a prefix")
    out = at.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_at").outer()).toDF(*names))
    return out.drop("_at")


def field(variant: str, path: str, kind: str = "string") -> Column:
    """A value inside a VARIANT as a type; null where it's missing or doesn't fit."""
    return F.try_variant_get(F.col(variant), path, kind)


def paired(df: DataFrame, variant: str, left: str, right: str) -> DataFrame:
    """SRC-09: df with a row for each key of the object at `left`: key, a (its value there) and b (the value of that key at
    `right`, null without it). Each row looks its answers up in its own object, so no join arises."""
    rows = members(df, variant, left, "_").filter("_key IS NOT NULL")  # a list has no keys
    answers = F.try_variant_get(F.col(variant), right, "map<string,variant>")
    return rows.select(*df.columns, F.col("_key").alias("key"), F.col("_value").alias("a"), F.try_element_at(answers, F.col("_key")).alias("b"))
