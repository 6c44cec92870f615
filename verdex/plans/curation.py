"""Curation: split, selection, quota, dedup with conflicts, views, membership, resume (queries over documents and labels).

An item is a document: id = doc_id, state = text, family = source, expected = its toxic label, agree = its quality label.
"""

from __future__ import annotations

from verdex.plans.dialect import Spark, both

#: Share of items for the dev split, of the generated source and of others, in 1/10000.
DEV_GEN, DEV_OTHER = 800, 400


def item(d: Spark) -> str:
    """Documents with their labels as items; src is the source's prefix, ord the input order."""
    return f"""item AS (SELECT d.doc_id AS id, d.doc_id AS ord, d.lang, d.text AS state, d.source, {d.split("coalesce(nullif(d.source, ''), 'gen')", ":", 1)} AS src,
  l.quality, l.toxic AS expected, {d.hex8("cast(d.doc_id as string)")} % 10000 AS bucket
  FROM {d.t('documents')} d LEFT JOIN {d.t('labels')} l ON d.doc_id = l.doc_id)"""


@both("content_id")
def content_id(d: Spark) -> str:
    """PRJ-10: a deterministic id from the content."""
    return f"SELECT doc_id, substr(sha1(concat(coalesce(text, ''), '|', coalesce(lang, ''))), 1, 16) AS iid FROM {d.t('documents')}"


@both("hash_bucket")
def hash_bucket(d: Spark) -> str:
    """PRJ-11, PRJ-12: dev bucket by the first 8 hex digits of the id's sha1, fold by the last digit's parity."""
    return f"SELECT doc_id, {d.hex8('cast(doc_id as string)')} % 10000 AS bucket, {d.hex1('cast(doc_id as string)')} % 2 AS fold FROM {d.t('documents')}"


@both("split_assignment")
def split_assignment(d: Spark) -> str:
    """FLT-03, FLT-04: held out by family, topic or language first, then dev by hash, else train."""
    return f"""WITH {item(d)} SELECT id, CASE WHEN lang = 'es' OR src IN ('src3') THEN 'heldout'
  WHEN bucket < CASE WHEN src = 'gen' THEN {DEV_GEN} ELSE {DEV_OTHER} END THEN 'validation' ELSE 'train' END AS split FROM item"""


@both("conflict_ids")
def conflict_ids(d: Spark) -> str:
    """WIN-02: texts whose copies have different answers leave altogether."""
    return f"""WITH {item(d)} SELECT sha1(coalesce(state, '')) AS k, count(*) AS copies, count(DISTINCT expected) AS answers FROM item
GROUP BY sha1(coalesce(state, '')) HAVING count(DISTINCT expected) > 1"""


@both("last_view_wins")
def last_view_wins(d: Spark) -> str:
    """WIN-03: of several views of an id the last by file and line holds. Views: a conversation's rows, file = role."""
    return f"""WITH v AS (SELECT conv_id AS id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS file_rank, turn AS ord, text AS view FROM {d.t('conversations')}),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_rank DESC, ord DESC) AS rn FROM v)
SELECT id, file_rank, ord, length(view) AS view_chars FROM w WHERE rn = 1"""


@both("distributions")
def distributions(d: Spark) -> str:
    """AGG-09: counts of several columns by split, in one pass over grouping sets."""
    return f"""WITH {item(d)}, s AS (SELECT *, CASE WHEN bucket < {DEV_OTHER} THEN 'validation' ELSE 'train' END AS split FROM item)
SELECT split, lang, src, expected, count(*) AS n, cast(grouping(lang) * 4 + grouping(src) * 2 + grouping(expected) as bigint) AS level FROM s
GROUP BY GROUPING SETS ((split, lang), (split, src), (split, expected))"""


@both("two_model_union")
def two_model_union(d: Spark) -> str:
    """JOIN-05, JOIN-06, FLT-12: two models' items by id, the first preferred, with the models that use each; splits must agree."""
    return f"""WITH {item(d)}, a AS (SELECT id, src, bucket < 400 AS dev FROM item WHERE id % 3 <> 0), b AS (SELECT id, src, bucket < 400 AS dev FROM item WHERE id % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.src, b.src) AS src, concat_ws(',', CASE WHEN a.id IS NOT NULL THEN 'm1' END, CASE WHEN b.id IS NOT NULL THEN 'm2' END) AS used_in,
  coalesce(a.dev, b.dev) = coalesce(b.dev, a.dev) AS split_agrees FROM a FULL OUTER JOIN b ON a.id = b.id"""


@both("base_writer")
def base_writer(d: Spark) -> str:
    """PRJ-13, JOIN-07: the writer of a derived item is that of its base item, or unknown."""
    return f"""WITH i AS (SELECT doc_id AS id, source AS src, CASE WHEN doc_id % 5 = 0 THEN concat(cast(doc_id + 400 as string), '-long12k') ELSE cast(doc_id as string) END AS long_id FROM {d.t('documents')}),
w AS (SELECT cast(doc_id as string) AS id, concat('writer_', lang) AS writer FROM {d.t('documents')})
SELECT i.id, i.long_id, {d.replace('i.long_id', '-long[0-9]+k$', '')} AS base_id, coalesce(w.writer, 'unknown') AS item_writer,
  CASE WHEN i.src IN ('src0', 'src1') THEN 'human' ELSE 'model' END AS label_source FROM i LEFT JOIN w ON w.id = {d.replace('i.long_id', '-long[0-9]+k$', '')}"""


@both("views_of_train")
def views_of_train(d: Spark) -> str:
    """JOIN-08: views of train items that aren't on the drop list."""
    return f"""WITH {item(d)}, v AS (SELECT DISTINCT conv_id AS id FROM {d.t('conversations')})
SELECT v.id FROM v WHERE v.id IN (SELECT id FROM item WHERE bucket >= 400) AND NOT EXISTS (SELECT 1 FROM item x WHERE x.id = v.id AND x.id % 7 = 0)"""


@both("resume_pending")
def resume_pending(d: Spark) -> str:
    """JOIN-12, STM-02: raw items minus those done and those that failed, each once."""
    return f"""WITH raw AS (SELECT DISTINCT doc_id AS id FROM {d.t('documents')}), done AS (SELECT doc_id AS id FROM {d.t('labels')} WHERE quality = 1), failed AS (SELECT doc_id AS id FROM {d.t('labels')} WHERE quality = 0)
SELECT id FROM raw WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.id = raw.id) AND NOT EXISTS (SELECT 1 FROM failed WHERE failed.id = raw.id)"""


@both("id_set_operations")
def id_set_operations(d: Spark) -> str:
    """SET-01..03: union, intersection and difference of id sets."""
    a, b = f"SELECT doc_id AS id FROM {d.t('labels')} WHERE toxic = 1", f"SELECT doc_id AS id FROM {d.t('labels')} WHERE quality = 1"
    return f"""SELECT 'union' AS op, count(*) AS n FROM ({a} UNION {b}) x UNION ALL SELECT 'intersect', count(*) FROM ({a} INTERSECT {b}) x
UNION ALL SELECT 'except', count(*) FROM ({a} EXCEPT {b}) x"""


@both("bag_union_sources")
def bag_union_sources(d: Spark) -> str:
    """SET-04: sources of different shapes as one relation, missing fields null."""
    return f"""SELECT kind, count(*) AS n, count(lang) AS with_lang FROM (SELECT doc_id AS id, 'document' AS kind, lang FROM {d.t('documents')}
UNION ALL SELECT page_id, 'page', NULL FROM {d.t('pages')} UNION ALL SELECT item_id, 'benchmark', NULL FROM {d.t('benchmark')}) u GROUP BY kind"""


@both("hash_sample")
def hash_sample(d: Spark) -> str:
    """SRT-05, SRT-08: the first 100 items in an order that the seed shuffles."""
    return f"SELECT doc_id, sha1(concat('42', cast(doc_id as string))) AS k FROM {d.t('documents')} ORDER BY k, doc_id LIMIT 100"
