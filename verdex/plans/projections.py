"""Scalar operators: options, distributions, JSON and text forms, validation."""

from __future__ import annotations

from verdex.plans.dialect import Spark, both


@both("normalize_probs")
def normalize_probs(d: Spark) -> str:
    """PRJ-06: negatives clipped to 0, divided by the sum; no positive mass, no target."""
    p = d.array("greatest(0, value - 20)", "greatest(0, 15 - value)", "greatest(0, value - 30) * 2")
    return f"""WITH e AS (SELECT event_id, {p} AS p FROM {d.t('events')}), s AS (SELECT event_id, p, {d.fold_sum('p')} AS z FROM e)
SELECT event_id, round({d.at('p', '1')} / nullif(z, 0), 7) AS p1, round({d.at('p', '2')} / nullif(z, 0), 7) AS p2, round({d.at('p', '3')} / nullif(z, 0), 7) AS p3 FROM s"""


@both("label_slug")
def label_slug(d: Spark) -> str:
    """PRJ-24."""
    return f"SELECT p_partkey, {d.replace('lower(p_name)', '[^a-z0-9_]', '_')} AS slug FROM {d.t('part')}"


@both("rounding")
def rounding(d: Spark) -> str:
    """PRJ-32: six places for probabilities, four for metrics."""
    return f"SELECT event_id, round(value / 7, 6) AS r6, round(value / 7, 4) AS r4 FROM {d.t('events')}"


@both("html_text")
def html_text(d: Spark) -> str:
    """Pages' visible text, tags and scripts removed; the title apart."""
    return f"SELECT page_id, length({d.replace(d.replace('html', '<(script|style)[^>]*>[^<]*</(script|style)>', ' '), '<[^>]*>', ' ')}) AS chars, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {d.t('pages')}"
