"""The item operators over literal items, with the rows that they must give."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.operators import items as I
from verdex.operators import textops
from verdex.plans.cases import cases

LONG = "The desk closes at 17:00 on weekdays; claims over 1200 or under 4500 wait for the 2026 review."
NOUL = {"type": "noul", "instructions": "Is it allowed?", "criteria": {"true": "It is, \"fully\".", "false": "It is not."}}
CHOICE = {"type": "choice", "instructions": "Where to?", "criteria": {"desk_a": "Desk: A", "desk_b": "Desk B", "bin": "Nowhere, ü"}}
SCORE = {"type": "score", "instructions": "How bad?", "criteria": ["fine", "bad", "awful"]}
YES_NO, DESKS, LEVELS = ["no", "yes"], ["bin", "desk_a", "desk_b"], ["0", "1", "2"]
OBJECT = {"z": "one, two: three", "amount": 1200, "a": [LONG]}


def item(id: str, question: dict, labels: list, expected: object, state: object = LONG, **more: object) -> dict:
    return {"id": id, "state": state, "question": question, "labels": labels, "expected": expected, **more}


ITEMS = [
    item("n", NOUL, YES_NO, "yes", teacher_probs={"yes": 0.6, "no": 0.2, "other": -1.0}, agree=True, source="gen:x", generator="w1", fmt="memo"),
    item("c", CHOICE, DESKS, "desk_a", OBJECT, gold_probs={"desk_a": 0.5, "bin": 0.5}, teacher_probs={"desk_b": 1.0}, family="routing"),
    item("s", SCORE, LEVELS, 2, gold_probs={}, teacher_probs={"0": 0.0, "1": -3.0}, topic="ops"),
    item("s-long12k", {**SCORE, "criteria": {"0": "none", "2": "much"}}, LEVELS, "1", teacher_probs={"2": 3.0, "1": 1.0}, source="generated", long_len=12000, long_doc=2, long_n_docs=5),
    item("e", {"type": "choice", "instructions": "", "criteria": {}}, ["x", "y"], "x"),
]


def some_items(spark: SparkSession, rows: list[dict] = ITEMS) -> DataFrame:
    lines = [json.dumps(r, ensure_ascii=False) for r in rows]
    return I.parse(spark.createDataFrame([(x,) for x in lines], "value string"))


def shown(of: str = "options") -> F.Column:
    return F.array_join(F.transform(of, lambda o: F.concat(o["label"], F.lit("="), o["description"])), "; ")


@cases("canonical_options", "id varchar, options varchar, aligned varchar", [
    ("n", 'yes=It is, "fully".; no=It is not.', "0.75,0.25"), ("c", "bin=Nowhere, ü; desk_a=Desk: A; desk_b=Desk B", "0.5,0.5,0.0"),
    ("s", "0=fine; 1=bad; 2=awful", None), ("s-long12k", "0=none; 1=1; 2=much", "0.0,0.25,0.75"), ("e", "x=x; y=y", None),
])
def canonical_options(spark: SparkSession) -> DataFrame:
    """PRJ-03, PRJ-05, PRJ-06: options in canonical order, and the target in their order (exact before the teacher's; negatives are 0)."""
    o = some_items(spark).withColumn("options", I.options())
    return o.select("id", shown().alias("options"), F.array_join(F.transform(I.aligned(F.col("options"), I.target()), lambda x: F.round(x, 6).cast("string")), ",").alias("aligned"))


@cases("options_roundtrip", "id varchar, labels varchar, criteria varchar, levels varchar, source varchar", [
    ("n", "no|yes", 'true=It is, "fully".;false=It is not.', None, "gen:x"), ("c", "bin|desk_a|desk_b", "bin=Nowhere, ü;desk_a=Desk: A;desk_b=Desk B", None, None),
    ("s", "0|1|2", None, "fine|bad|awful", None), ("s-long12k", "0|1|2", None, "none|1|much", None), ("e", "x|y", "x=x;y=y", None, None),
])
def options_roundtrip(spark: SparkSession) -> DataFrame:
    """PRJ-04: options back to labels, criteria or levels; a source that says only `generated` is none."""
    labels, criteria, levels = I.question_of(F.col("qtype"), F.col("options"))
    o = some_items(spark).withColumn("options", I.options())
    entries = F.array_join(F.transform(F.map_entries(criteria), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return o.select("id", F.array_join(labels, "|").alias("labels"), entries.alias("criteria"), F.array_join(levels, "|").alias("levels"), I.source_of(F.col("source")).alias("source"))


def _text(r: dict) -> str:
    return r["state"] if isinstance(r["state"], str) else json.dumps(r["state"], ensure_ascii=False)


@cases("item_text", "id varchar, text varchar", [(r["id"], f"{_text(r)} {r['question']['instructions']}") for r in ITEMS])
def item_text(spark: SparkSession) -> DataFrame:
    """PRJ-02, PRJ-16: an object state as JSON with spaces after commas and colons, and the item's text."""
    return some_items(spark).select("id", I.text().alias("text"))


@cases("item_content_id", "id varchar, iid varchar", [
    (r["id"], hashlib.sha1(((r["state"] if isinstance(r["state"], str) else json.dumps(r["state"], sort_keys=True)) + json.dumps(r["question"], sort_keys=True)).encode()).hexdigest()[:16])
    for r in ITEMS if r["id"] != "e"
])
def item_content_id(spark: SparkSession) -> DataFrame:
    """PRJ-10: an id from the state and the question, keys sorted."""
    return some_items(spark, [r for r in ITEMS if r["id"] != "e"]).select("id", I.content_id().alias("iid"))


OPTIONS = {
    "n": [("true", 'It is, "fully".'), ("false", "It is not.")], "c": [("bin", "Nowhere, ü"), ("desk_a", "Desk: A"), ("desk_b", "Desk B")],
    "s": [("0", "fine"), ("1", "bad"), ("2", "awful")], "s-long12k": [("0", "none"), ("1", "1"), ("2", "much")], "e": [("x", "x"), ("y", "y")],
}


def _prompt(r: dict) -> str:
    listed = [{"letter": "ABC"[i], "description": f"{a}: {b}"} for i, (a, b) in enumerate(OPTIONS[r["id"]])]
    return json.dumps({"evidence": r["state"], "criterion": r["question"]["instructions"], "options": listed}, ensure_ascii=False)


def _plain(r: dict) -> str:
    name = {"true": "yes", "false": "no"} if r["id"] == "n" else {}
    lines = "\n".join(f"{'ABC'[i]}. {name.get(a, a)}: {b}" for i, (a, b) in enumerate(OPTIONS[r["id"]]))
    return f"State:\n{_text(r)}\n\nQuestion: {r['question']['instructions']}\n\nOptions:\n{lines}\n\nAnswer with the letter of the correct option."


@cases("item_prompt", "id varchar, prompt varchar, plain varchar", [(r["id"], _prompt(r), _plain(r)) for r in ITEMS])
def item_prompt(spark: SparkSession) -> DataFrame:
    """PRJ-26, PRJ-27: the question as JSON and as plain lines, options under their codes."""
    o = some_items(spark).withColumn("options", I.options()).withColumn("codes", textops.option_codes())
    return o.select("id", I.prompt(F.col("options"), F.col("codes")).alias("prompt"), I.prompt(F.col("options"), F.col("codes"), "plain").alias("plain"))


def _spans(r: dict) -> list[tuple]:
    text, at, out = _prompt(r), _prompt(r).index('"options"'), []
    for k, (a, b) in enumerate(OPTIONS[r["id"]]):
        needle = json.dumps(f"{a}: {b}", ensure_ascii=False)
        at = text.index(needle, at)
        out.append((r["id"], k, text[at + 1 : at + len(needle) - 1]))
        at += len(needle)
    return out


@cases("option_spans", "id varchar, k bigint, covered varchar", [x for r in ITEMS for x in _spans(r)])
def option_spans(spark: SparkSession) -> DataFrame:
    """PRJ-33: where each option's description stands in the prompt, shown by the text there."""
    o = some_items(spark).withColumn("options", I.options())
    o = o.withColumn("prompt", I.prompt(F.col("options"), textops.option_codes()))
    spans = o.select("id", "prompt", F.posexplode(I.option_starts(F.col("prompt"), F.col("options"))).alias("k", "s"))
    return spans.select("id", F.col("k").cast("bigint").alias("k"), F.substring("prompt", F.col("s.begin") + 1, F.col("s.end") - F.col("s.begin")).alias("covered"))


TEN = [f"l{i}" for i in range(10)]
BROKEN = [
    ("ok_noul", None, item("ok_noul", NOUL, YES_NO, "no")), ("ok_choice", None, item("ok_choice", CHOICE, DESKS, "bin")), ("ok_score", None, item("ok_score", SCORE, LEVELS, 0)),
    ("type", "type/labels", item("type", {**NOUL, "type": "rank"}, YES_NO, "no")), ("no_labels", "type/labels", item("no_labels", NOUL, None, "no")),
    ("blank", "type/labels", item("blank", {**NOUL, "instructions": ""}, YES_NO, "no")), ("order", "noul", item("order", NOUL, ["yes", "no"], "no")),
    ("maybe", "noul", item("maybe", NOUL, YES_NO, "maybe")), ("keys", "noul", item("keys", {**NOUL, "criteria": {"true": "x"}}, YES_NO, "no")),
    ("two", "choice", item("two", {**CHOICE, "criteria": {"a": "", "b": ""}}, ["a", "b"], "a")), ("case", "choice", item("case", {**CHOICE, "criteria": dict.fromkeys("Abc", "x")}, ["A", "b", "c"], "A")),
    ("twice", "choice", item("twice", CHOICE, [*DESKS, "bin"], "bin")), ("absent", "choice", item("absent", CHOICE, DESKS, "desk_c")), ("criteria", "choice", item("criteria", {**CHOICE, "criteria": {"bin": ""}}, DESKS, "bin")),
    ("few_large", "choice", item("few_large", CHOICE, DESKS, "bin", family="large_choice")), ("ten_large", None, item("ten_large", {**CHOICE, "criteria": dict.fromkeys(TEN, "x")}, TEN, "l3", family="large_choice")),
    ("short_scale", "score", item("short_scale", {**SCORE, "criteria": ["a", "b"]}, ["0", "1"], 0)), ("names", "score", item("names", SCORE, ["a", "b", "c"], 0)), ("map_scale", "score", item("map_scale", {**SCORE, "criteria": {"0": "x"}}, LEVELS, 0)),
    ("word", "score-exp", item("word", SCORE, LEVELS, "bad")), ("three", "score-range", item("three", SCORE, LEVELS, 3)), ("minus", "score-range", item("minus", SCORE, LEVELS, -1)),
    ("short", "short-state", item("short", NOUL, YES_NO, "no", "too short")), ("none", "short-state", item("none", NOUL, YES_NO, "no", None)), ("edge", None, item("edge", NOUL, YES_NO, "no", "x" * 80)), ("below", "short-state", item("below", NOUL, YES_NO, "no", "x" * 79)),
    ("leak", "leak", item("leak", NOUL, YES_NO, "no", {"gold": LONG})), ("inner", None, item("inner", NOUL, YES_NO, "no", {"a": {"gold": LONG}})),
    ("probs", "gold_probs", item("probs", NOUL, YES_NO, "no", family="probability")), ("sum", "gold_probs", item("sum", NOUL, YES_NO, "no", family="probability", gold_probs={"no": 0.5, "yes": 0.53})),
    ("near", None, item("near", NOUL, YES_NO, "no", family="probability", gold_probs={"no": 0.5, "yes": 0.515})), ("probs_keys", "gold_probs", item("probs_keys", NOUL, YES_NO, "no", family="probability", gold_probs={"no": 1.0})),
]


@cases("validator_reason", "id varchar, reason varchar", [(i, r) for i, r, _ in BROKEN])
def validator_reason(spark: SparkSession) -> DataFrame:
    """FLT-05, FLT-10, SET-06: the first rule that an item breaks."""
    return some_items(spark, [x for *_, x in BROKEN]).select("id", I.invalid().alias("reason"))


@cases("target_check", "id varchar, asked varchar, rejected boolean", [("n", "yes", False), ("n", "no", True), ("n", None, False), ("c", "no", False)])
def target_check(spark: SparkSession) -> DataFrame:
    """FLT-06: a yes/no item must have the answer that was asked for."""
    asked = spark.createDataFrame([("n", "yes"), ("n", "no"), ("n", None), ("c", "no")], "id string, asked string")
    return some_items(spark).join(F.broadcast(asked), "id").select("id", "asked", I.wrong_target(F.col("asked")).alias("rejected"))


@cases("degenerate_candidates", "id bigint, rejected boolean", [(0, False), (1, True), (2, True), (3, True), (4, True)])
def degenerate_candidates(spark: SparkSession) -> DataFrame:
    """FLT-11: one label, a label twice, gold missing, no labels."""
    rows = [(0, ["a", "b"], "a"), (1, ["a"], "a"), (2, ["a", "b", "a"], "a"), (3, ["a", "b"], "c"), (4, None, "a")]
    return spark.createDataFrame(rows, "id bigint, labels array<string>, gold string").select("id", I.degenerate(F.col("labels"), F.col("gold")).alias("rejected"))


VIEWS = [
    ("n", "ok", {"state": "El 1200, 4500 y 2026."}, None), ("n", "object", {"state": {"a": 1}}, "state-type"), ("n", "lost", {"state": "El 1200 y 4500."}, "numbers"), ("n", "blank", {"state": LONG, "instructions": "  "}, "instructions"),
    ("n", "keys", {"state": LONG, "question": {**NOUL, "criteria": {"true": "x"}}}, "criteria"), ("c", "same", {"state": {"a": LONG, "amount": 1200, "z": ""}, "question": CHOICE}, None),
    ("c", "state_keys", {"state": {"a": LONG, "amount": 1200}, "question": CHOICE}, "state-keys"), ("s", "levels", {"state": LONG, "question": {**SCORE, "criteria": ["a", "b"]}}, "criteria"), ("s", "list", {"state": LONG, "question": SCORE}, None),
]


@cases("view_checks", "id varchar, view varchar, reason varchar", [(i, v, r) for i, v, _, r in VIEWS])
def view_checks(spark: SparkSession) -> DataFrame:
    """FLT-07: a view keeps the state's type and keys, the criteria, instructions and 90 % of the numbers of three digits and more."""
    views = [item(f"{i}/{v}", {**(x.get("question") or NOUL), "instructions": x.get("instructions", "ask")}, [], None, x["state"]) for i, v, x, _ in VIEWS]
    v = some_items(spark, views).select(F.split_part("id", F.lit("/"), F.lit(1)).alias("id"), F.split_part("id", F.lit("/"), F.lit(2)).alias("view"), *(F.col(x).alias(f"v_{x}") for x in ("state", "is_object", "criteria", "levels", "instructions")))
    return some_items(spark).join(v, "id").select("id", "view", I.view_reason().alias("reason"))


@cases("release_record", "id varchar, format varchar, source varchar, upstream varchar, item_writer varchar, label_source varchar, expected varchar, target varchar, teacher varchar, long_answer_doc bigint, violation varchar", [
    ("n", "memo", "gen:x", "corpus x", "w1", "teacher", "yes", "0.75,0.25", "0.75,0.25", None, None), ("c", None, "generated", None, "w9", "writer_exact_probs", "desk_a", "0.5,0.5,0.0", "0.0,0.0,1.0", None, None),
    ("s", None, "generated", None, "program", "exact_probability", "2", None, None, None, "mass"), ("s-long12k", None, "generated", None, "w2", "teacher", "1", "0.0,0.25,0.75", "0.0,0.25,0.75", 2, None),
    ("e", None, "generated", None, "unknown", "teacher", "x", None, None, None, "mass"),
])
def release_record(spark: SparkSession) -> DataFrame:
    """PRJ-01, PRJ-13, FLT-12, JOIN-07: released fields, writers with the base item's for long ones, and what is inconsistent."""
    files = F.when(F.col("id").isin("n", "c", "e"), "labeled.jsonl").when(F.col("id") == "s", "prog_prob.jsonl").otherwise("long_items.jsonl")
    rows = some_items(spark).withColumn("split", F.lit("train")).withColumn("file", files).withColumn("used_in", F.array(F.lit("m")))
    writers = spark.createDataFrame([("c", "w9"), ("s", "w2")], "id string, writer string")
    r = I.release_record(rows, writers, {"gen:x": "corpus x"})
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.join(I.violations(r), "id", "left").select("id", "format", "source", "upstream", "item_writer", "label_source", "expected", joined("target_probs").alias("target"), joined("teacher_probs").alias("teacher"), "long_answer_doc", "violation")
