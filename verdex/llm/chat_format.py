"""Chat formatting by event-sourced reconstruction: conversation logs are folded into final messages and rendered.

The rendered form of a turn is `<s>ROLE\\nTEXT</s>\\n`. Inside role and text a backslash is doubled and each control string
gets a backslash after its first character, so no control string survives in them and the original can be read back. A line
feed in a role is written as a backslash and an n, which no other escape gives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdex.llm.common import table

#: What must not appear inside a turn: the template's own marks and the marks of other common templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
_ESCAPE = re.compile("|".join([r"\\", *(re.escape(c) for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>\n", re.S)

EVENTS = "conv_id bigint, turn bigint, part bigint, seq bigint, kind string, role string, text string"
TURNS = "conv_id bigint, turn bigint, part bigint, role string, rendered string, loss_start bigint, loss_end bigint"


def escape(text: str) -> str:
    """text without control strings; unescape() gives it back."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _role_of(written: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], written)


def render(role: str, text: str, trained: frozenset[str] = frozenset({"assistant"})) -> tuple[str, int, int]:
    """One turn as the template has it, and the bounds (code points) of what the loss covers in it; (0, 0): nothing."""
    head = f"<s>{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role in trained else (0, 0)
    return f"{head}{body}</s>\n", *span


def read_back(rendered: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    for m in _TURN.finditer(rendered):
        yield _role_of(m[1]), unescape(m[2])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final messages from events sorted by message and sequence; holds one message at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    key, role, pieces, out, size = None, "", [], [], 0

    def close() -> None:
        nonlocal size
        if key is not None:
            rendered = render(role, "".join(pieces))
            out.append((*key, role, *rendered))
            size += len(rendered[0])

    for batch in batches:
        for conv, turn, part, kind, who, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "part", "kind", "role", "text")), strict=True):
            if (conv, turn, part) != key:
                close()
                key, role, pieces = (conv, turn, part), "", []
            if who is not None:
                role = who
            if kind == "delta":
                pieces.append(text or "")
            elif kind in ("message", "edit"):
                pieces = [text or ""]
            elif kind == "regenerate":
                pieces = [text] if text else []
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into final messages and render each: conv_id, turn, part, role, rendered, loss_start, loss_end.

    events has EVENTS' columns (others are ignored): a message is named by (conv_id, turn, part) and changed by its events
    in the order of seq: `delta` appends, `message` and `edit` set the whole text, `regenerate` drops what was streamed so
    far and starts again with its text, other kinds change nothing. The last role that isn't null holds; none at all is the
    empty role. Null text is empty; events with one seq apply by kind and text. A message without text is still a turn.
    An empty log gives no rows. A conversation's rendered text is its turns' `rendered` in the order of turn and part.

    Events are dealt by message, so a conversation with any share of the log is spread over tasks; a task streams its
    sorted events and holds one message.
    """
    log = events.select(*(x.split()[0] for x in EVENTS.split(", ")))
    dealt = log.repartition("conv_id", "turn", "part").sortWithinPartitions("conv_id", "turn", "part", "seq", "kind", "text")
    return dealt.mapInArrow(_fold, TURNS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its rendered turns in order; holds running digests only."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    out: list[tuple] = []
    started, conv = False, None
    n = loss = chars = 0
    turns, masked = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        for c, rendered, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
            if not started or c != conv:
                if started:
                    out.append((conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                started, conv, n, loss, chars = True, c, 0, 0, 0
                turns, masked = hashlib.sha256(), hashlib.sha256()
            for role, text in read_back(rendered):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            covered = unescape(rendered[a:b])
            masked.update(covered.encode())
            loss += len(covered)
            chars += len(rendered)
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if started:
        out.append((conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation: what reading its rendered turns back gives. A digest is sequential, so a task streams a whole conversation; it holds no text."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return dealt.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_events(rows: DataFrame, piece: int = 256) -> DataFrame:
    """A log, as a chat service has it, whose fold gives the rows (conv_id, turn, role, text) again; each row is a message.

    An assistant's message is streamed: a draft, which `regenerate` drops, then deltas of `piece` characters. Any other is
    sent with its text reversed and then edited. The last event stands first, so seq alone gives the order.
    """
    text = F.coalesce("text", F.lit(""))
    event = lambda seq, kind, of: F.struct(F.lit(seq).cast("bigint").alias("seq") if isinstance(seq, int) else seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), of.alias("text"))
    none = F.lit(None).cast("string")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / piece) - 1, F.lit(0)).cast("int")), lambda i: event(i + 2, "delta", F.substring(text, i * piece + 1, F.lit(piece))))
    streamed = F.concat(F.array(event(0, "delta", F.concat(F.lit("draft of "), F.substring(text, 1, 20))), event(1, "regenerate", none)), pieces)
    typed = F.array(event(0, "message", F.reverse(text)), event(1, "edit", text))
    log = rows.withColumn("part", F.monotonically_increasing_id())  # rows that repeat a turn stay apart
    log = log.select("conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), F.explode(F.reverse(F.when(F.col("role") == "assistant", streamed).otherwise(typed))).alias("e"))
    return log.select("conv_id", "turn", "part", "e.seq", "e.kind", "role", "e.text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings: a log with drafts, deltas, regenerations and
    edits of them, folded, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(reconstruct(as_events(rows.unionByName(planted))))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + marks + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
