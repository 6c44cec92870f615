"""Rules as data: conditions and clause lists that compile to columns, so they stay in whole-stage code."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdex.operators.textops import formatted

#: UDF-04: comparisons by name; more can be registered.
COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "=": operator.eq, "<>": operator.ne,
    "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v),
}

Condition = tuple[str, str, object]


def condition(c: Condition) -> Column:
    """UDF-02: one (attribute, comparison, value) as a column; a null attribute doesn't satisfy it."""
    attribute, comparison, value = c
    return F.coalesce(COMPARISONS[comparison](F.col(attribute), value), F.lit(False))


def holding(conditions: Iterable[Column], k: int) -> Column:
    """RUL-05: whether k of the conditions hold, given as columns; a null doesn't."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0)) >= k


def at_least(conditions: Iterable[Condition], k: int) -> Column:
    """RUL-05: whether k of the conditions hold."""
    return holding(map(condition, conditions), k)


def first_match(clauses: Iterable[tuple[list[Condition], str]], default: str) -> Column:
    """JOIN-16, RUL-10: the verdict of the first clause all of whose conditions hold."""
    out = None
    for conditions, verdict in clauses:
        holds = at_least(conditions, len(conditions))
        out = F.when(holds, verdict) if out is None else out.when(holds, verdict)
    return F.lit(default) if out is None else out.otherwise(default)


#: A clause: its condition, and whether it permits or forbids.
Clause = tuple[Condition, str]


def cite(clauses: list[Clause], k: int) -> Column:
    """RUL-10: whether clause k (from 1) alone allows: `permit` only if its condition holds, `forbid` unless it does."""
    c, effect = clauses[k - 1]
    return condition(c) if effect == "permit" else ~condition(c)


def first_applicable(clauses: list[Clause]) -> tuple[Column, Column]:
    """RUL-10: (number of the first clause whose condition holds, or null; whether it allows, and true if there is none)."""
    number = F.coalesce(*(F.when(condition(c), i) for i, (c, _) in enumerate(clauses, 1)))
    allowed = F.coalesce(*(F.when(condition(c), effect == "permit") for c, effect in clauses), F.lit(True))
    return number, allowed


# Words of the two languages.
YES = {"en": ("yes", "no"), "pt": ("sim", "não")}
TRUE = {"en": ("true", "false"), "pt": ("sim", "não")}


def shown(value: Column, kind: str, lang: str = "en") -> Column:
    """RUL-12: a value as text: money 1,234.50 (pt 1.234,50), float and pct plain (pt with a comma), bool yes or no, dates."""
    if kind == "bool":
        return F.when(value, YES[lang][0]).otherwise(YES[lang][1])
    if kind == "date":
        return F.date_format(value, "dd/MM/yyyy" if lang == "pt" else "dd MMM yyyy")
    if kind == "money":
        return formatted(value.cast("double"), "pt" if lang == "pt" else "comma")
    if kind in ("float", "pct"):
        plain = formatted(value.cast("double"), "plain")
        return F.replace(plain, F.lit("."), F.lit(",")) if lang == "pt" else plain
    return value.cast("string")


def trace(c: Condition, text: str, value: Column | None = None, lang: str = "en") -> Column:
    """RUL-11: a condition as text, its value computed out if given, and what it comes to."""
    outcome = F.when(condition(c), TRUE[lang][0]).otherwise(TRUE[lang][1])
    return F.concat(F.lit(text), *(() if value is None else (F.lit(" ["), value, F.lit("]"))), F.lit(" → "), outcome)


# How derived quantities are computed out, by name: (parts, text between them).
DERIVED: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "notional": lambda f: F.concat(f("quantity"), F.lit(" x "), f("price"), F.lit(" = "), f("notional")),
    "day_total_after": lambda f: F.concat(f("amount"), F.lit(" + "), f("daily_total"), F.lit(" = "), f("day_total_after")),
    "dti": lambda f: F.concat(F.lit("("), f("debt"), F.lit(" + "), f("installment"), F.lit(") / "), f("income"), F.lit(" x 100 = "), f("dti"), F.lit("%")),
    "tolerance": lambda f: F.concat(F.lit("|"), f("invoice_amount"), F.lit(" - "), f("credit_amount"), F.lit("| / "), f("credit_amount"), F.lit(" x 100 = "), f("tolerance"), F.lit("%")),
    "payable": lambda f: F.concat(F.lit("max(0, "), f("claimed"), F.lit(" - "), f("deductible"), F.lit(") = "), f("payable")),
}


def derived(df: DataFrame) -> DataFrame:
    """RUL-00: df with each derived quantity whose parts it has."""
    parts = {
        "notional": (("quantity", "price"), lambda: F.col("quantity") * F.col("price")), "day_total_after": (("amount", "daily_total"), lambda: F.col("amount") + F.col("daily_total")),
        "dti": (("debt", "installment", "income"), lambda: F.round((F.col("debt") + F.col("installment")) / F.col("income") * 100, 2)),
        "tolerance": (("invoice_amount", "credit_amount"), lambda: F.round(F.abs(F.col("invoice_amount") - F.col("credit_amount")) / F.col("credit_amount") * 100, 2)),
        "payable": (("claimed", "deductible"), lambda: F.greatest(F.lit(0.0), F.col("claimed") - F.col("deductible"))),
    }
    return df.select("*", *(f().alias(n) for n, (needs, f) in parts.items() if set(needs) <= set(df.columns)))


#: An attribute of a case: name, kind (int, money, float, pct, enum, bool, date), and its bounds, choices or first day.
Attribute = tuple[str, str, tuple]


def sample_cases(ids: DataFrame, attributes: list[Attribute], seed: str = "1") -> DataFrame:
    """RUL-00: a case for each id, its attributes drawn by hash of seed, name and id, and what derives from them.

    int from low to high, both included; money to two places, float and pct to one; dates up to 120 days after the first.
    """
    unit = lambda name: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)

    def draw(name: str, kind: str, par: tuple) -> Column:
        u = unit(name)
        if kind == "enum":
            return F.get(F.array(*map(F.lit, par)), F.floor(u * len(par)).cast("int"))
        if kind == "bool":
            return u < 0.5
        if kind == "date":
            return F.date_add(F.lit(par[0]).cast("date"), F.floor(u * 121).cast("int"))
        low, high = par
        return (low + F.floor(u * (high - low + 1))).cast("bigint") if kind == "int" else F.round(low + u * (high - low), 2 if kind == "money" else 1)

    return derived(ids.select("id", *(draw(*a).alias(a[0]) for a in attributes)))


def render_case(attributes: list[tuple[str, str, str, str]], entity: str, style: str, lang: str = "en") -> Column:
    """RUL-12: a case as json, table or prose in English or Portuguese.

    attributes: (name, kind, English label, Portuguese label) in the order in which they are shown, distractors among them.
    """
    pairs = [(pt if lang == "pt" else en, shown(F.col(name), kind, lang)) for name, kind, en, pt in attributes]
    if style == "table":
        return F.concat_ws("\n", *(F.concat(F.lit(f"| {k} | "), v, F.lit(" |")) for k, v in pairs))
    if style == "json":
        quoted = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
        lines = [F.lit(f' "{"caso" if lang == "pt" else "case"}": "{entity}"'), *(F.concat(F.lit(f' "{k}": '), quoted(v)) for k, v in pairs)]
        return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    listed = F.concat_ws("; ", *(F.concat(F.lit(f"{k}: "), v) for k, v in pairs))
    head = f"Dados d{'a' if entity.startswith('a ') else 'o'} {entity.split(' ', 1)[-1]}: " if lang == "pt" else f"Facts about the {entity}: "
    return F.concat(F.lit(head), listed, F.lit("."))
