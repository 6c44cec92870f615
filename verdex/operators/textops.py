"""Operators on text: document keys, markers, numbers, option codes, JSON inside prose, filler and images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-letter codes that the tokenizer splits, which therefore name no option.
SPLIT_CODES = frozenset(
    "BQ BZ CJ CQ CZ DQ DZ EJ EY FJ FQ FV FZ GJ GK GQ GZ HJ IY JF JG JH JL JN JQ JW JX JY JZ KJ KQ KX KZ LH LJ LQ LW LX "
    "LZ OJ OQ OY OZ PQ PZ QD QF QI QJ QK QO QV QW QX QY QZ RQ RZ TJ TQ UJ UO UQ UW VH VJ VQ VU VW VX VY VZ WJ WQ WU WV "
    "WY WZ XG XJ XK XN XO XQ XU XV XW XZ YB YD YF YH YI YJ YK YQ YR YU YV YX ZB ZC ZD ZG ZJ ZK ZL ZM ZP ZQ ZS ZT ZU ZV".split()
)
_LETTERS = [chr(65 + i) for i in range(26)]
#: PRJ-27: option codes by position, 588 in all.
CODES = [*_LETTERS, *(c for c in (a + b for a in _LETTERS for b in _LETTERS) if c not in SPLIT_CODES)]


def option_codes() -> Column:
    """PRJ-27: all codes as an array."""
    return F.split(F.lit(" ".join(CODES)), " ")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def document_key(state: Column) -> Column:
    """PRJ-20: what stands before the proposed answer and the question, without the standing request, 600 characters of it."""
    before = F.split_part(F.split_part(state, F.lit("Proposed answer:"), F.lit(1)), F.lit("Question:"), F.lit(1))
    plain = F.regexp_replace(before, r"Please answer the given financial question based on the context\.?", "")
    return F.substring(strip(F.regexp_replace(plain, r"(?U)\s+", " ")), 1, 600)


def before_first(text: Column, marker: str) -> Column:
    """PRJ-21: the text before a marker's first place; all of it if there is none."""
    return F.split_part(text, F.lit(marker), F.lit(1))


def after_last(text: Column, marker: str) -> Column:
    """PRJ-21: the text after a marker's last place, trimmed; all of it if there is none."""
    return strip(F.split_part(text, F.lit(marker), F.lit(-1)))


def answer_only(state: Column, solution: str = "Proposed solution:", answer: str = "Proposed final answer:") -> tuple[Column, Column, Column]:
    """PRJ-21, FLT-08: (state without the solution, format, whether the answer has a decimal point and leaves)."""
    tail = after_last(state, answer)
    with_solution = F.contains(state, F.lit(solution))
    short = F.concat(before_first(state, f"\n\n{solution}"), F.lit(f"\n\n{answer} "), tail)
    return F.when(with_solution, short).otherwise(state), F.when(with_solution, "sol").otherwise("ans"), F.contains(tail, F.lit("."))


def number(text: Column) -> Column:
    """PRJ-22: a number without thousands commas, currency and percent signs; null for anything else."""
    return strip(F.regexp_replace(text, "[,$%]", "")).try_cast("double")


def reference_answer(solution: Column) -> tuple[Column, Column]:
    """PRJ-21: (body without calculator marks, final number) of a worked solution that ends with #### and a number."""
    body = strip(F.regexp_replace(before_first(solution, "####"), "<<[^>]*>>", ""))
    return body, F.regexp_replace(after_last(solution, "####"), ",", "")


def formatted(x: Column, style: str, decimals: int = 2) -> Column:
    """PRJ-23: a number as plain (6 significant digits), r2, comma, pct, usd, source (its own decimals) or pt (1.234,50)."""
    two = F.format_string("%.2f", x)
    comma = F.format_string("%,.2f", x)
    if style == "plain":
        digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(x)))).cast("int")
        short = F.regexp_replace(F.regexp_replace(F.format_number(x, 12), ",", ""), r"\.?0+$", "")
        rounded = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", F.expr("0d") + F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)), ",", ""), r"\.?0+$", "")
        return F.when(x == 0, "0.000000").when(F.abs(x) < 1e-3, F.format_string("%.6f", x)).otherwise(F.coalesce(rounded, short))
    return {"r2": two, "comma": comma, "pct": F.concat(two, F.lit("%")), "usd": F.concat(F.lit("$"), comma), "source": F.format_string(f"%.{decimals}f", x), "pt": F.translate(comma, ",.", ".,")}[style]


def outermost_json(text: Column) -> Column:
    """PRJ-25: from the first to the last brace of a text, if that is JSON; else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((found != "") & (F.json_array_length(F.concat(F.lit("["), found, F.lit("]"))) == 1), found)


def json_items(text: Column, key: str = "items") -> Column:
    """PRJ-25: the elements of a list in the outermost JSON of a text, as JSON; none without it."""
    return F.coalesce(F.from_json(F.get_json_object(outermost_json(text), f"$.{key}"), "array<string>"), F.array().cast("array<string>"))


def haystack(case: Column, lines: Column, depth: Column, filler: tuple[str, ...]) -> Column:
    """PRJ-28: a case between filler lines, behind the share `depth` of them; filler: the lines, in turn, {i} for a line's number."""
    line = lambda i: F.get(F.array(*map(F.lit, filler)), i % len(filler))
    each = F.when(lines > 0, F.transform(F.sequence(F.lit(0), F.greatest(lines, F.lit(1)) - 1), lambda i: F.replace(line(i), F.lit("{i}"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    at = F.floor(lines * depth).cast("int")
    part = lambda a, n: F.array_join(F.slice(each, a, n), "")
    return F.concat(part(F.lit(1), at), F.lit("\n=== CASE FILE (relevant) ===\n"), case, F.lit("\n=== END OF CASE FILE ===\n"), part(at + 1, F.greatest(lines - at, F.lit(0))))


IMAGE = r"data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/]+=*"


def lift_images(state: Column, start: Column) -> tuple[Column, Column]:
    """PRJ-30: (state with `[image N]` for each image's data URI, the URIs), numbered in order behind `start`.

    The state is a text, or the JSON of any nesting: a URI has no character that JSON escapes, so strings inside lists and
    objects are met in the order in which they stand.
    """
    found = F.regexp_extract_all(state, F.lit(IMAGE), F.lit(0))
    between = F.split(state, IMAGE, -1)
    marked = F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("[image "), (start + i).cast("string"), F.lit("]"), x)))
    return F.array_join(marked, ""), found


def keep_apart(values: Column, tolerance: float = 0.004) -> Column:
    """SET-05: values in order, without those within the tolerance of one that was kept before."""
    add = lambda kept, v: F.when(F.exists(kept, lambda u: F.abs(v - u) <= tolerance), kept).otherwise(F.concat(kept, F.array(v)))
    return F.aggregate(values, F.array().cast("array<double>"), add)


def truncated(df: DataFrame, state: str, tokens: Callable[[Column], Column], budget: int, tries: int = 4, marker: str = "\n[...]\n") -> DataFrame:
    """PRJ-29: df with `state` cut until its tokens fit, and `fits`: whether they did within so many tries.

    tokens: of a text, how many tokens its prompt has. A text that has too many keeps 0.9 x budget / tokens of its characters,
    70 % of them from its head and 30 % from its tail, around the marker, and is looked at again. A null state fits as it is.
    """
    kept = df.columns
    df = df.withColumn("_fits", F.lit(None).cast("boolean"))
    for _ in range(tries):
        df = df.withColumn("_n", tokens(F.col(state)))
        fits = F.coalesce(F.col("_fits"), F.when(F.coalesce(F.col("_n") <= budget, F.lit(True)), True))
        keep = F.floor(F.length(state) * budget / F.col("_n") * 0.9)
        short = F.concat(F.left(F.col(state), F.floor(keep * 0.7).cast("int")), F.lit(marker), F.right(F.col(state), F.floor(keep * 0.3).cast("int")))
        df = df.withColumns({"_fits": fits, state: F.when(fits, F.col(state)).otherwise(short)})
    return df.select(*kept, F.coalesce("_fits", F.lit(False)).alias("fits"))
