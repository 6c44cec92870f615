"""Suite builders: rows of unlike datasets in one shape, (id, task, family, lang, state, qtype, instructions, criteria, labels, expected)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A builder gives a task's rows; it may fail, as when its data isn't there.
Builder = Callable[[], DataFrame]


def slug(x: Column) -> Column:
    """PRJ-24: a label of lower-case letters, digits and underscores."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9_]", "_")


def item(rows: DataFrame, task: str, key: Column, state: Column, qtype: str, instructions: Column | str, criteria: Column, labels: Column, expected: Column, lang: str = "English") -> DataFrame:
    """Rows as suite items; a row without an expected answer among its labels is left out."""
    text = F.lit(instructions) if isinstance(instructions, str) else instructions
    out = rows.select(
        F.concat(F.lit(f"{task}-"), key.cast("string")).alias("id"), F.lit(task).alias("task"), F.lit(task.split("_")[0]).alias("family"), F.lit(lang).alias("lang"), state.alias("state"),
        F.lit(qtype).alias("qtype"), text.alias("instructions"), criteria.alias("criteria"), labels.alias("labels"), expected.alias("expected"),
    )
    return out.filter(F.array_contains("labels", F.col("expected")))


def _map(*pairs: tuple[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs for x in p))


def yes_no(rows: DataFrame, task: str, key: Column, state: Column, instructions: Column | str, answer: Column, true: str = "Yes.", false: str = "No.", lang: str = "English") -> DataFrame:
    """Questions of passages, entailment and the like: a yes or no."""
    return item(rows, task, key, state, "noul", instructions, _map(("true", true), ("false", false)), F.array(F.lit("no"), F.lit("yes")), F.when(answer, "yes").when(~answer, "no"), lang)


def intents(rows: DataFrame, task: str, key: Column, message: Column, label: Column, names: list[str]) -> DataFrame:
    """A message's intent, by number in a list of names."""
    slugs = F.transform(F.array(*map(F.lit, names)), slug)
    described = F.transform(F.array(*map(F.lit, names)), lambda n: F.replace(n, F.lit("_"), F.lit(" ")))
    return item(rows, task, key, F.concat(F.lit("Customer message: "), message), "choice", "Which intent does the customer message express?", F.map_from_arrays(slugs, described), slugs, F.get(slugs, label.cast("int")))


def options(rows: DataFrame, task: str, key: Column, state: Column, instructions: str, texts: Column, answer: Column) -> DataFrame:
    """Multiple choice: options as an array of texts, the answer's number."""
    labels = F.transform(texts, lambda _, i: F.concat(F.lit("option_"), F.char(97 + i)))
    return item(rows, task, key, state, "choice", instructions, F.map_from_arrays(labels, texts), labels, F.get(labels, answer.cast("int")))


def classes(rows: DataFrame, task: str, key: Column, state: Column, instructions: str, answer: Column, values: list[str], lang: str = "English") -> DataFrame:
    """A class out of a list: yes and no as a yes/no question, others under their slugs of 40 characters at most."""
    if {v.lower() for v in values} <= {"yes", "no"}:
        return yes_no(rows, task, key, state, instructions, F.lower(F.trim(answer)) == "yes", lang=lang)
    labels = F.transform(F.array(*map(F.lit, values)), lambda v: F.substring(slug(v), F.lit(1), F.lit(40)))
    at = F.array_position(F.array(*map(F.lit, values)), F.trim(answer))
    return item(rows, task, key, state, "choice", instructions, F.map_from_arrays(labels, F.array(*map(F.lit, values))), labels, F.get(labels, at.cast("int") - 1), lang)


def pairs(rows: DataFrame, task: str, key: Column, prompt: Column, chosen: Column, rejected: Column, seed: str = "11") -> DataFrame:
    """Two responses in a seeded order; the chosen one is right."""
    first = F.conv(F.right(F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string"))), F.lit(1)), 16, 10).cast("int") % 2 == 0
    a, b = F.when(first, chosen).otherwise(rejected), F.when(first, rejected).otherwise(chosen)
    state = F.concat(F.lit("User request:\n"), prompt, F.lit("\n\nResponse A:\n"), a, F.lit("\n\nResponse B:\n"), b)
    criteria = _map(("response_a", "Response A is better."), ("response_b", "Response B is better."))
    return item(rows, task, key, state, "choice", "Which response better fulfils the user's request?", criteria, F.array(F.lit("response_a"), F.lit("response_b")), F.when(first, "response_a").otherwise("response_b"))


def sample(rows: DataFrame, key: str, n: int, seed: str = "11") -> DataFrame:
    """SRT-05: n rows in a seeded order of their key."""
    return rows.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def build(builders: dict[str, Builder]) -> tuple[DataFrame | None, dict[str, str]]:
    """SUI-01: the union of the tasks whose builder works, and of the others the name of what went wrong.

    A builder fails when its plan can't be made (a table or column that isn't there); nothing is read for that.
    """
    suite, skipped = None, {}
    for name, builder in builders.items():
        try:
            one = builder()
            one.schema  # noqa: B018  resolves the plan
        except AnalysisException as e:  # another error is a builder's fault, and isn't hidden
            skipped[name] = type(e).__name__
            continue
        suite = one if suite is None else suite.unionByName(one)
    return suite, skipped
