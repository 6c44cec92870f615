"""Typed decision items: reading them from JSON, options and targets, validation, rendering and the release record.

An item is a row with ITEM's columns. criteria is a map (yes/no and choice questions), levels a list (score questions); state is
text, or the JSON of an object, which is_object tells. All functions are columns over such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = (
    "id string, family string, topic string, lang string, difficulty string, fmt string, state string, is_object boolean, qtype string, instructions string, "
    "criteria map<string,string>, levels array<string>, labels array<string>, expected string, gold_probs map<string,double>, teacher_probs map<string,double>, "
    "agree boolean, source string, generator string, rationale string, long_len bigint, long_doc bigint, long_n_docs bigint"
)
#: Keys of an object state that give the answer away.
LEAK_KEYS = ("expected", "label", "ground_truth", "answer_key", "gold")
OPTION = "array<struct<label: string, description: string>>"


def spaced(json: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside strings, as the reference's serialiser writes it (PRJ-02)."""
    return F.regexp_replace(json, r'\G((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^",:]++)*+)([,:]) ?', "$1$2 ")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Items of JSON lines, with ITEM's columns; a line that is no JSON object gives a row of nulls (SRC-02)."""
    at = lambda path: F.get_json_object(F.col(column), f"$.{path}")
    plain = ("id", "family", "topic", "lang", "difficulty", "fmt", "source", "generator", "rationale", "expected")
    criteria, state, probs = at("question.criteria"), at("state"), "map<string,double>"
    return lines.select(
        *(at(x).alias(x) for x in plain),
        F.when(F.ltrim(state).startswith("{"), spaced(state)).otherwise(state).alias("state"),
        F.coalesce(F.ltrim(state).startswith("{"), F.lit(False)).alias("is_object"),
        at("question.type").alias("qtype"), at("question.instructions").alias("instructions"),
        F.when(criteria.startswith("{"), F.from_json(criteria, "map<string,string>")).alias("criteria"),
        F.when(criteria.startswith("["), F.from_json(criteria, "array<string>")).alias("levels"),
        F.from_json(at("labels"), "array<string>").alias("labels"),
        F.from_json(at("gold_probs"), probs).alias("gold_probs"), F.from_json(at("teacher_probs"), probs).alias("teacher_probs"),
        at("agree").cast("boolean").alias("agree"), *(at(x).cast("bigint").alias(x) for x in ("long_len", "long_doc", "long_n_docs")),
    ).select(*(x.split()[0] for x in ITEM.split(", ")))


def _option(label: Column, description: Column) -> Column:
    return F.struct(label.alias("label"), description.alias("description"))


def options() -> Column:
    """PRJ-03: the item's options in canonical order, as OPTION.

    Yes/no questions: yes, then no, described by the criteria `true` and `false`. Score questions: a list of levels by index,
    or labels described by a map. Others: labels in order; a label without a criterion describes itself.
    """
    of = lambda key, default: F.coalesce(F.get(F.map_values(F.map_filter("criteria", lambda k, _: k == key)), F.lit(0)), default)
    yes_no = F.array(_option(F.lit("yes"), of(F.lit("true"), F.lit("yes"))), _option(F.lit("no"), of(F.lit("false"), F.lit("no"))))
    by_label = F.transform("labels", lambda x: _option(x, of(x, x)))
    by_level = F.transform("levels", lambda x, i: _option(i.cast("string"), x))
    return F.when(F.col("qtype").isin("noul", "boolean"), yes_no).when((F.col("qtype") == "score") & F.col("levels").isNotNull(), by_level).otherwise(by_label)


def question_of(qtype: Column, of: Column) -> tuple[Column, Column, Column]:
    """PRJ-04: (labels, criteria, levels) of a release record's options: no before yes, with the criteria `true` and `false`;
    a score's levels are a list, other criteria a map."""
    noul, score = qtype.isin("noul", "boolean"), qtype == "score"
    key = lambda label: F.when(noul & (label == "yes"), "true").when(noul & (label == "no"), "false").otherwise(label)
    labels = F.when(noul, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.transform(of, lambda o: o["label"]))
    criteria = F.when(~score, F.map_from_entries(F.transform(of, lambda o: F.struct(key(o["label"]), o["description"]))))
    return labels, criteria, F.when(score, F.transform(of, lambda o: o["description"]))


def source_of(source: Column) -> Column:
    """PRJ-04: a record's source, null if it was only `generated`."""
    return F.when(source != "generated", source)


def aligned(of: Column, probs: Column) -> Column:
    """PRJ-05: the probability of each option in order, 0 where the map has none; null without a map."""
    value = lambda label: F.get(F.map_values(F.map_filter(probs, lambda k, _: k == label)), F.lit(0))
    return F.when(probs.isNotNull(), F.transform(of, lambda o: F.coalesce(value(o["label"]), F.lit(0.0))))


def normalised(probs: Column) -> Column:
    """PRJ-06: negatives as 0, divided by the sum; null without positive mass."""
    clipped = F.transform_values(probs, lambda _, v: F.greatest(F.lit(0.0), v))
    total = F.aggregate(F.map_values(clipped), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform_values(clipped, lambda _, v: v / total))


def target() -> Column:
    """The item's target: its exact probabilities, or where these are missing or empty the teacher's."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return normalised(F.coalesce(some("gold_probs"), some("teacher_probs")))


def same_set(a: Column, b: Column) -> Column:
    """SET-06: whether two arrays have the same elements, however often."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def invalid() -> Column:
    """FLT-05: the first rule that an item breaks, null if it breaks none."""
    n, keys = F.size("labels"), F.map_keys("criteria")
    fits = F.when(F.col("family") == "large_choice", n.between(10, 26)).otherwise(n.between(3, 7))
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    noul = F.col("labels").eqNullSafe(F.array(F.lit("no"), F.lit("yes"))) & F.col("expected").isin("no", "yes") & same_set(keys, F.array(F.lit("true"), F.lit("false")))
    choice = fits & (F.size(F.array_distinct("labels")) == n) & F.array_contains("labels", F.col("expected")) & same_set(keys, F.col("labels")) & F.forall("labels", lambda x: F.coalesce(x, F.lit("")).rlike("^[a-z0-9_]+$"))
    levels = F.size("levels")
    score = levels.between(3, 6) & F.col("labels").eqNullSafe(F.transform(F.sequence(F.lit(0), F.greatest(levels, F.lit(1)) - 1), lambda i: i.cast("string")))
    whole = F.trim(F.col("expected")).try_cast("int")
    probs = F.col("gold_probs").isNotNull() & same_set(F.map_keys("gold_probs"), F.col("labels")) & (F.abs(F.aggregate(F.map_values("gold_probs"), F.lit(0.0), lambda a, x: a + x) - 1) <= 0.02)
    return (
        F.when(broken(F.col("qtype").isin("noul", "choice", "score")) | F.col("labels").isNull() | (F.coalesce("instructions", F.lit("")) == ""), "type/labels")
        .when((F.col("qtype") == "noul") & broken(noul), "noul").when((F.col("qtype") == "choice") & broken(choice), "choice")
        .when((F.col("qtype") == "score") & broken(score), "score").when((F.col("qtype") == "score") & whole.isNull(), "score-exp")
        .when((F.col("qtype") == "score") & broken((whole >= 0) & (whole < levels)), "score-range")
        .when(F.coalesce(F.length("state"), F.lit(0)) < 80, "short-state")
        .when(F.col("is_object") & F.arrays_overlap(F.json_object_keys("state"), F.array(*map(F.lit, LEAK_KEYS))), "leak")
        .when((F.col("family") == "probability") & broken(probs), "gold_probs")
    )


def wrong_target(asked: Column) -> Column:
    """FLT-06: whether a yes/no item has another answer than was asked for."""
    return (F.col("qtype") == "noul") & asked.isNotNull() & ~F.col("expected").eqNullSafe(asked)


def degenerate(labels: Column, gold: Column) -> Column:
    """FLT-11: fewer than two labels, a label twice, or no gold among them."""
    return ~F.coalesce((F.size(labels) >= 2) & (F.size(F.array_distinct(labels)) == F.size(labels)) & F.array_contains(labels, gold), F.lit(False))


def view_reason(least: float = 0.9) -> Column:
    """FLT-07: the first rule that a view (v_state, v_is_object, v_criteria, v_levels, v_instructions) of an item breaks, or null."""
    numbers = F.array_distinct(F.regexp_extract_all("state", F.lit(r"\d{3,}"), F.lit(0)))
    kept = F.size(F.filter(numbers, lambda x: F.coalesce(F.contains(F.col("v_state"), x), F.lit(False))))
    keys = lambda is_object, state: F.when(F.col(is_object), F.json_object_keys(state))
    return (
        F.when(~F.col("is_object").eqNullSafe(F.col("v_is_object")) | F.col("v_state").isNull(), "state-type")
        .when(~same_set(keys("is_object", "state"), keys("v_is_object", "v_state")), "state-keys")
        .when(~same_set(F.map_keys("criteria"), F.map_keys("v_criteria")) | ~F.size("levels").eqNullSafe(F.size("v_levels")), "criteria")
        .when(F.trim(F.coalesce("v_instructions", F.lit(""))) == "", "instructions").when((F.size(numbers) > 0) & (kept < least * F.size(numbers)), "numbers")
    )


def text() -> Column:
    """PRJ-16: the state's text and the instructions."""
    return F.concat_ws(" ", F.coalesce("state", F.lit("")), F.coalesce("instructions", F.lit("")))


def content_id() -> Column:
    """PRJ-10: 16 hex digits of the sha1 of the state and the question, as JSON with sorted keys and ASCII letters only."""
    entries = F.when(F.col("criteria").isNotNull(), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("criteria"))))).otherwise(F.to_json("levels"))
    named = (("criteria", spaced(entries)), ("instructions", _quoted(F.col("instructions"))), ("type", _quoted(F.col("qtype"))))
    parts = F.filter(F.array(*(F.concat(F.lit(f'"{k}": '), v) for k, v in named)), lambda x: x.isNotNull())
    state = F.when(F.col("is_object"), _ascii(spaced(F.to_json(F.try_parse_json("state"))))).otherwise(F.coalesce("state", F.lit("")))
    return F.substring(F.sha1(F.concat(state, F.lit("{"), _ascii(F.array_join(parts, ", ")), F.lit("}"))), 1, 16)


def _quoted(x: Column) -> Column:
    """A JSON string, letters beyond ASCII as they are."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _ascii(json: Column) -> Column:
    """JSON with the letters beyond ASCII as escapes, those beyond the first plane as pairs."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 65536, unit(F.ascii(c))).otherwise(F.concat(unit(55296 + F.floor((F.ascii(c) - 65536) / 1024)), unit(56320 + (F.ascii(c) - 65536) % 1024)))
    return F.when(json.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(json, ""), code), "")).otherwise(json)


def prompt(of: Column, codes: Column, style: str = "json") -> Column:
    """PRJ-26: state, question and options as one text; codes gives the letters by position.

    `json`: evidence, criterion, options with their letters, yes and no shown as true and false. Otherwise plain lines.
    """
    noul = F.col("qtype").isin("noul", "boolean")
    if style == "json":
        shown = lambda x: F.when(noul & (x == "yes"), "true").when(noul & (x == "no"), "false").otherwise(x)
        each = F.transform(of, lambda o, i: F.concat(F.lit('{"letter": "'), F.get(codes, i), F.lit('", "description": '), _quoted(F.concat(shown(o["label"]), F.lit(": "), o["description"])), F.lit("}")))
        state = F.when(F.col("is_object"), F.col("state")).otherwise(_quoted(F.coalesce("state", F.lit(""))))
        return F.concat(F.lit('{"evidence": '), state, F.lit(', "criterion": '), _quoted(F.coalesce("instructions", F.lit(""))), F.lit(', "options": ['), F.array_join(each, ", "), F.lit("]}"))
    each = F.transform(of, lambda o, i: F.concat(F.get(codes, i), F.lit(". "), o["label"], F.lit(": "), o["description"]))
    return F.concat(F.lit("State:\n"), F.coalesce("state", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("instructions", F.lit("")), F.lit("\n\nOptions:\n"), F.array_join(each, "\n"), F.lit("\n\nAnswer with the letter of the correct option."))


def option_starts(text: Column, of: Column) -> Column:
    """PRJ-33: (begin, end) of each option's description in a json prompt, code points from 0; null if one is missing.

    Options are looked for one after another, behind the key of the options, so equal texts have places of their own.
    """
    noul = F.col("qtype").isin("noul", "boolean")
    shown = lambda x: F.when(noul & (x == "yes"), "true").when(noul & (x == "no"), "false").otherwise(x)
    start = F.struct(F.locate('"options"', text).alias("at"), F.array().cast("array<struct<begin: int, end: int>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        needle = _quoted(F.concat(shown(o["label"]), F.lit(": "), o["description"]))
        at = F.call_function("locate", needle, text, acc["at"])
        found = (acc["at"] > 0) & (at > 0)
        place = F.struct(at.alias("begin"), (at + F.length(needle) - 2).alias("end"))
        return F.struct(F.when(found, at + F.length(needle)).otherwise(0).alias("at"), F.when(found, F.concat(acc["out"], F.array(place))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(of, start, step, lambda a: F.when(a["at"] > 0, a["out"]))


def writer(derived: Column, generator: Column, base: Column) -> Column:
    """PRJ-13: who wrote a generated item: its own generator, else that of its base item, else unknown."""
    return F.when(derived, F.coalesce(generator, base, F.lit("unknown"))).otherwise("program")


def base_id(id: Column) -> Column:
    """PRJ-13: an id without its last `-long` and what follows."""
    return F.when(F.contains(id, F.lit("-long")), F.regexp_replace(id, r"(?s)^(.*)-long.*$", "$1")).otherwise(id)


def release_record(items: DataFrame, writers: DataFrame, upstream: dict[str, str]) -> DataFrame:
    """PRJ-01: the released fields of items that have `split`, `file` and `used_in`; writers: (id, writer) of generated items.

    fmt is renamed format, long_doc long_answer_doc; target and teacher probabilities stand in the order of the options,
    rounded to six places; items of `labeled*` and `long_items` files are generated, others come from a program.
    """
    generated = F.col("file").rlike("^(labeled|long_items)")
    base = F.when(F.col("file").startswith("long_items"), base_id(F.col("id"))).otherwise(F.col("id"))
    joined = items.withColumn("_base", base).join(writers.select(F.col("id").alias("_base"), "writer"), "_base", "left")
    o = joined.withColumn("options", options())
    known = F.create_map(*(F.lit(x) for pair in upstream.items() for x in pair)) if upstream else F.lit(None).cast("map<string,string>")
    six = lambda probs: F.transform(aligned(F.col("options"), probs), lambda x: F.round(x, 6))
    return o.select(
        "id", "split", "family", "topic", "lang", "difficulty", F.col("fmt").alias("format"), F.coalesce("source", F.lit("generated")).alias("source"), known[F.col("source")].alias("upstream"),
        writer(generated, F.col("generator"), F.col("writer")).alias("item_writer"),
        F.when(generated, F.when(F.size("gold_probs") > 0, "writer_exact_probs").otherwise("teacher")).when(F.col("file").startswith("prog_prob"), "exact_probability").otherwise("program").alias("label_source"),
        "state", F.col("qtype").alias("question_type"), F.coalesce("instructions", F.lit("")).alias("instructions"), "options", "expected",
        six(target()).alias("target_probs"), F.when(generated, six(normalised(F.col("teacher_probs")))).alias("teacher_probs"), "rationale", "used_in",
        "long_len", "long_n_docs", F.col("long_doc").alias("long_answer_doc"),
    )


def violations(records: DataFrame) -> DataFrame:
    """FLT-12: (id, violation) of release records: the answer isn't an option, the mass isn't 1, an option twice."""
    total = F.aggregate("target_probs", F.lit(0.0), lambda a, x: a + x)
    labels = F.transform("options", lambda o: o["label"])
    found = F.array_compact(F.array(
        F.when(~F.coalesce(F.array_contains(labels, F.col("expected")), F.lit(False)), "expected"),
        F.when(~F.coalesce(F.abs(total - 1) < 1e-5, F.lit(False)), "mass"), F.when(F.size(F.array_distinct(labels)) < F.size(labels), "options"),
    ))
    return records.select("id", F.explode(found).alias("violation"))
