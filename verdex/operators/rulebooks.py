"""JOIN-16, RUL-10: rules as a relation that meets cases through an index of bounds, so neither rules x cases pairs nor an
expression per rule arise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdex.operators import ranks

#: Clauses of an index, a bit each, and indexes of a cell in a pass over the cases.
BLOCK, INDEXES = 2048, 8
#: Cells at most that one attribute is cut into, rows per clause that its cells may make, and cases of a cell in one task.
CELLS, SPREAD, CASES = 1024, 4, 250_000
#: Conditions of a relation of rules: `number` or `text` is the bound; members of one `in` or `not in` are rows of their own.
CONDITIONS = "clause bigint, attribute string, op string, number double, text string"


class Attribute:
    """The bounds of one attribute in order, and for each place between, on and beyond them (and for null) a bit per clause."""

    def __init__(self, conditions: pd.DataFrame, column: str, clauses: np.ndarray):
        values, op = conditions[column], conditions["op"].to_numpy(object)
        at = np.searchsorted(clauses, conditions["clause"].to_numpy(np.int64))
        told = values.notna().to_numpy()
        some = values[told].to_numpy(float if column == "number" else object)
        self.bounds = np.unique(some) if column == "number" else np.array(sorted(set(some)), object)
        n = len(self.bounds)
        on = np.zeros(len(at), np.int64)  # code 2 i: under bound i, 2 i + 1: on it, 2 n: over all, 2 n + 1: null
        on[told] = 2 * np.searchsorted(self.bounds, some) + 1
        low, high = np.zeros(len(clauses), np.int64), np.full(len(clauses), 2 * n)
        for name, step in ((">=", 0), (">", 1), ("=", 0)):
            rows = told & (op == name)
            np.maximum.at(low, at[rows], on[rows] + step)
        for name, step in (("<=", 0), ("<", -1), ("=", 0)):
            rows = told & (op == name)
            np.minimum.at(high, at[rows], on[rows] + step)
        members = (op == "in") | (op == "not in")
        high[at[~told & ~members]] = -1  # a bound of null is met by nothing
        code = np.arange(2 * n + 2)[:, None]
        ok = (code >= low) & (code <= high)
        rows = told & ((op == "<>") | (op == "not in"))
        ok[on[rows], at[rows]] = False
        if (op == "in").any():
            listed, place = np.unique(at[op == "in"], return_inverse=True)
            inside = np.zeros((len(ok), len(listed)), bool)
            inside[on[op == "in"], place] = True
            inside[0] = False  # where members of null were put
            ok[:, listed] &= inside
        ok[-1] = True
        ok[-1, at] = False
        bits = np.packbits(ok, axis=1, bitorder="little")
        wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
        wide[:, : bits.shape[1]] = bits
        self.bits = wide.view(np.uint64)

    def codes(self, col: pa.Array) -> np.ndarray:
        null = col.is_null().to_numpy(zero_copy_only=False)
        if self.bounds.dtype == object:
            d = col.cast(pa.string()).dictionary_encode()
            words = d.dictionary.to_pylist()
            at = np.searchsorted(self.bounds, np.array(words, object)) if words else np.zeros(0, np.int64)
            hit = np.array([i < len(self.bounds) and self.bounds[i] == w for i, w in zip(at.tolist(), words, strict=True)], bool)
            of = pa.compute.fill_null(d.indices, 0).to_numpy(zero_copy_only=False)
            out = (2 * at + hit)[of] if len(words) else np.zeros(len(col), np.int64)
        else:
            x = pa.compute.fill_null(col.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(self.bounds, x)
            hit = self.bounds[np.minimum(at, len(self.bounds) - 1)] == x if len(self.bounds) else np.zeros(len(x), bool)
            out = 2 * at + hit
        out[null] = 2 * len(self.bounds) + 1
        return out


class Index:
    """A block of clauses, in order, one without conditions holds; of each case the first whose conditions all hold, or -1."""

    def __init__(self, clauses: np.ndarray, conditions: pd.DataFrame):
        self.clauses = clauses
        self.attributes: list[tuple[str, Attribute]] = []
        for (name, kind), rows in conditions.assign(kind=np.where(conditions["text"].isna(), "number", "text")).groupby(["attribute", "kind"]):
            self.attributes.append((name, Attribute(rows, kind, clauses)))
        bits = np.packbits(np.ones(len(clauses), bool), bitorder="little")
        self.all = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
        self.all[: len(bits)] = bits

    def first(self, columns: dict[str, pa.Array], n: int) -> np.ndarray:
        left = np.repeat(self.all.view(np.uint64)[None], n, 0)
        for name, a in self.attributes:
            left &= a.bits[a.codes(columns[name])]
        some = left != 0
        word = some.argmax(1)
        w = left[np.arange(n), word]
        lowest = np.frexp((w & (~w + np.uint64(1))).astype(np.float64))[1] - 1
        return np.where(some.any(1), self.clauses[np.minimum(64 * word + lowest, len(self.clauses) - 1)], -1)


def _indexes(clauses: list[pa.Array], of: list[pa.Array], block: int) -> list[Index]:
    """The indexes of a cell: its clauses come in order, each with the list of its conditions."""
    if not clauses:
        return []
    ids, lists = pa.concat_arrays(clauses).to_numpy(), pa.concat_arrays(of)
    each = np.repeat(ids, lists.value_lengths().to_numpy())
    flat = lists.flatten()
    rows = pd.DataFrame({"clause": each, **{c: flat.field(c).to_pandas() for c in ("attribute", "op", "number", "text")}})
    cut = np.searchsorted(each, ids[::block])
    return [Index(ids[k * block : (k + 1) * block], rows.iloc[i:j]) for k, (i, j) in enumerate(zip(cut, [*cut[1:], len(rows)], strict=True))]


def _pivot(cases: DataFrame, conditions: DataFrame) -> str | None:
    """The column of numbers that most conditions bound from a side."""
    kinds = {n: t for n, t in cases.dtypes if t.startswith(("decimal", "double", "float", "bigint", "int", "smallint", "tinyint"))}
    sides = conditions.filter(F.col("op").isin(">=", ">", "<=", "<", "=") & F.col("number").isNotNull() & F.col("attribute").isin(*kinds))
    most = sides.groupBy("attribute").count().orderBy(F.desc("count"), "attribute").first() if kinds else None
    return most and most["attribute"]


def _placed(conditions: DataFrame, pivot: str | None, block: int) -> tuple[DataFrame, list[float]]:
    """(cell, clause, of): in each cell of the pivot the clauses that may hold there, with the conditions that are open there;
    and the cells' bounds. Cell -1 has what may hold of a null. Of clauses that say the same in a cell the least is there."""
    whole = conditions.groupBy("clause").agg(F.array_sort(F.collect_set(F.struct("attribute", "op", "number", "text"))).alias("of")).groupBy("of").agg(F.min("clause").alias("clause"))
    if pivot is None:
        return whole.select(F.lit(-1).alias("cell"), "clause", "of"), []
    sided = lambda c, ops: (c["attribute"] == pivot) & c["number"].isNotNull() & c["op"].isin(*ops)
    side = lambda *ops: F.transform(F.filter("of", lambda c: sided(c, ops)), lambda c: c["number"])
    whole = whole.select("clause", "of", F.array_max(side(">=", ">", "=")).alias("low"), F.array_min(side("<=", "<", "=")).alias("high"))
    n, bounds = whole.select(F.explode(F.array("low", "high")).alias("x")).agg(F.count("*") / 2, F.percentile_approx("x", [k / CELLS for k in range(1, CELLS)], 10 * CELLS)).first()
    bounds = sorted({x for x in bounds or [] if x == x})
    bounds = bounds[:: max(1, len(bounds) * block // max(1, int(2 * n)))]
    cell = lambda x, otherwise: F.coalesce(F.when(x.isNotNull(), ranks.bucket(x, bounds) if bounds else F.lit(0)), F.lit(otherwise))
    spans = whole.agg(F.avg(cell(F.col("high"), len(bounds)) - cell(F.col("low"), 0) + 1)).first()[0]
    if spans and spans > SPREAD:
        bounds = bounds[:: -(-int(spans) // SPREAD) + 1]
    free = ~F.exists("of", lambda c: c["attribute"] == pivot)
    reach = whole.withColumns({"_from": cell(F.col("low"), 0), "_to": cell(F.col("high"), len(bounds))}).filter("_from <= _to")
    each = reach.select("*", F.explode(F.sequence(F.when(free, -1).otherwise(F.col("_from")), F.col("_to"))).alias("cell"))
    beyond = lambda c: sided(c, (">=", ">")) & (F.col("cell") > F.col("_from")) | sided(c, ("<=", "<")) & (F.col("cell") < F.col("_to"))
    left = each.select("cell", "clause", F.filter("of", lambda c: ~F.coalesce(beyond(c), F.lit(False))).alias("of"))
    return left.groupBy("cell", "of").agg(F.min("clause").alias("clause")), bounds


def first_clauses(cases: DataFrame, conditions: DataFrame, block: int = BLOCK, indexes: int = INDEXES) -> DataFrame:
    """cases with `first_clause`: the least clause all of whose conditions hold; null without one.

    conditions: CONDITIONS. A clause is the conjunction of its rows: op is one of >= > <= < = <> in, not in; attribute names a
    column of cases. A null attribute satisfies no condition, nor does a bound of null, and a clause without rows isn't there.

    The number that most conditions bound is cut into cells by quantiles of the bounds. A clause goes to the cells that it
    reaches, less its bounds that hold all over the cell, and of clauses that then say the same the least stays; so a case
    meets those of its cell. In a cell the bounds of all clauses cut each attribute's values into places, and each place knows,
    a bit per clause, whose conditions hold there. A case looks up its places, and the first bit that all of them have is its
    clause: some hundred bytes per attribute and block, whatever the number of clauses that hold. Indexes are built in the
    tasks, from a cell's clauses in blocks of `block`, `indexes` of which a pass takes, so what a task holds has a bound (2
    bounds x 256 bytes a condition). Cases that no clause of a pass takes go on to the next, in cells that have more; with
    clauses that reach far, or without a number, cells are few and passes many. A cell with many cases is several tasks.
    """
    kept, pivot = cases.columns, _pivot(cases, conditions)
    placed, bounds = _placed(conditions, pivot, block)
    of: Column = F.lit(-1)
    if pivot:
        x = F.col(pivot).cast("double")
        of = F.when(x.isNull(), -1).otherwise(ranks.bucket(x, bounds) if bounds else F.lit(0))
    dealt = cases.withColumn("_cell", of)
    most = placed.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    tasks = {r["_cell"]: -(-r["count"] // CASES) for r in dealt.groupBy("_cell").count().collect()}  # a row per cell
    split = F.get(F.array(*(F.lit(tasks.get(k, 0)) for k in range(-1, len(bounds) + 1))), F.col("_cell") + 1)
    passes = max(1, -(-most // (block * indexes)))
    if passes > 1:
        placed = placed.withColumn("_pass", F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("clause")) - 1) / (block * indexes)))
    schema = T.StructType([*cases.schema.fields, T.StructField("first_clause", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, clauses, lists, built = None, [], [], None
        for b in batches:
            cell, salt, kind = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_cell", "_salt", "_kind"))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                column = lambda name, part=part: part.column(part.schema.get_field_index(name))
                if (cell[i], salt[i]) != at:
                    at, clauses, lists, built = (cell[i], salt[i]), [], [], None
                if not kind[i]:
                    clauses.append(column("_clause"))
                    lists.append(column("_of"))
                    continue
                if built is None:
                    built, clauses, lists = _indexes(clauses, lists, block), [], []
                found = np.full(j - i, -1, np.int64)
                for index in built:
                    todo = np.flatnonzero(found < 0)
                    if not len(todo):
                        break
                    found[todo] = index.first({name: column(name).take(pa.array(todo)) for name, _ in index.attributes}, len(todo))
                yield pa.RecordBatch.from_arrays([*(column(c) for c in kept), pa.array(found, mask=found < 0)], names=schema.names)

    out, left = None, dealt
    for k in range(passes):
        rules = placed if passes == 1 else placed.filter(F.col("_pass") == k)
        rules = rules.select(F.col("cell").alias("_cell"), F.lit(0).alias("_kind"), F.col("clause").alias("_clause"), F.col("of").alias("_of"))
        rules = rules.select("*", split.alias("_split")).filter("_split > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_split") - 1)).alias("_salt")).drop("_split")
        met = left.withColumns({"_salt": F.pmod(F.monotonically_increasing_id(), split).cast("int"), "_kind": F.lit(1)}).unionByName(rules, allowMissingColumns=True)
        told = met.repartition("_cell", "_salt").sortWithinPartitions("_cell", "_salt", "_kind", "_clause").mapInArrow(run, schema)
        if k < passes - 1:
            there = cases.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
            told = told.checkpoint() if there else told.localCheckpoint()
            left = told.filter("first_clause IS NULL").select(*kept).withColumn("_cell", of)
            told = told.filter("first_clause IS NOT NULL")
        out = told if out is None else out.unionByName(told)
    return out


def cited(cases: DataFrame, conditions: DataFrame, clause: str) -> DataFrame:
    """cases with `holds`: whether all conditions of the clause that a case cites (a column of its own) hold; null without it.

    Each case meets the conditions of one clause, by an equi-join; attributes come as two maps, of numbers and of texts.
    """
    kinds = dict(cases.dtypes)
    is_text = lambda c: kinds[c] in ("string", "date", "boolean") or kinds[c].startswith("timestamp")
    named = lambda cols, kind: F.create_map(*(x for c in cols for x in (F.lit(c), F.col(c).cast(kind)))) if cols else F.create_map().cast(f"map<string,{kind}>")
    rows = cases.withColumns({"_case": F.monotonically_increasing_id(), "_numbers": named([c for c in kinds if not is_text(c)], "double"), "_texts": named([c for c in kinds if is_text(c)], "string")})
    grouped = conditions.groupBy("clause", "attribute", "op").agg(F.collect_list(F.struct("number", "text")).alias("bounds"))
    x, y = F.col("_numbers")[F.col("attribute")], F.col("_texts")[F.col("attribute")]

    def one(b):  # noqa: ANN001, ANN202
        test = lambda v, w: F.when(F.col("op").isin("=", "in"), v == w).when(F.col("op").isin("<>", "not in"), v != w).when(F.col("op") == ">=", v >= w).when(F.col("op") == ">", v > w).when(F.col("op") == "<=", v <= w).otherwise(v < w)
        return F.coalesce(F.when(b["text"].isNotNull(), test(y, b["text"])).otherwise(test(x, b["number"])), F.lit(False))

    holds = F.when(F.col("op") == "in", F.exists("bounds", one)).otherwise(F.forall("bounds", one))
    clauses = grouped.groupBy("clause").agg(F.collect_list(F.struct("attribute", "op", "bounds")).alias("_all")).withColumnRenamed("clause", "_clause")
    met = rows.join(clauses, rows[clause] == clauses["_clause"], "left").select(*rows.columns, F.explode_outer("_all").alias("_c"))
    met = met.select(*rows.columns, "_c.attribute", "_c.op", "_c.bounds").withColumn("_holds", F.when(F.col("op").isNotNull(), holds))
    return met.groupBy("_case", *cases.columns).agg(F.min("_holds").alias("holds")).drop("_case")
