"""Personal data by anchor expansion: one Aho-Corasick pass finds cues, small parsers grow and validate each span."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verdex.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone", "url_login", "iban", "ssn", "account")
_DIGITS = frozenset("0123456789")
_ALPHA = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LABEL = _ALPHA | _DIGITS | {"-"}
_LOCAL = _LABEL | set("._%+")
_PHONE = _DIGITS | set(" ().-")
_ALNUM = _ALPHA | _DIGITS
#: Words that announce an account number; a number of 6 to 17 digits must follow within a few characters.
CUES = ("account", "acct", "a/c no", "iban", "konto", "compte", "cuenta", "ssn", "social security", "routing", "passport", "member id", "customer id")

Span = tuple[int, int]


def _automaton() -> ahocorasick.Automaton:
    """Cues: at-signs, schemes, plus signs, digits (each a possible address, card or number start) and identifier words."""
    a = ahocorasick.Automaton()
    for cue, kind in [("@", "at"), ("://", "scheme"), ("+", "plus"), *((d, "digit") for d in "0123456789"), *((c, "word") for x in CUES for c in {x, x.upper(), x.capitalize(), x.title()})]:
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _run(t: str, i: int, of: frozenset[str] | set[str]) -> int:
    """Where the run of `of` characters from i ends."""
    n = len(t)
    while i < n and t[i] in of:
        i += 1
    return i


def email_at(t: str, at: int, floor: int) -> Span | None:
    """The address around an at-sign; its local part starts at floor at the earliest."""
    start = at
    while start > floor and t[start - 1] in _LOCAL:
        start -= 1
    label = _run(t, at + 1, _LABEL)
    if start == at or label == at + 1:
        return None
    end = label
    while end < len(t) and t[end] == "." and (nxt := _run(t, end + 1, _LABEL)) > end + 1:
        end = nxt
    return (start, end) if end > label else None


def quad_at(t: str, i: int) -> int:
    """The end of four dotted numbers that start at i, or 0."""
    end = _run(t, i, _DIGITS)
    for _ in range(3):
        if end >= len(t) or t[end] != "." or (nxt := _run(t, end + 1, _DIGITS)) == end + 1:
            return 0
        end = nxt
    return end


def digits_at(t: str, i: int) -> int:
    """The end of digits from i with single spaces or hyphens between them."""
    end, n = i + 1, len(t)
    while end < n:
        if t[end] in _DIGITS:
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def phone_at(t: str, plus: int) -> int:
    """The end of a phone number after a plus sign, or 0: a digit, then signs, up to the last digit of the run."""
    if plus + 1 >= len(t) or t[plus + 1] not in _DIGITS:
        return 0
    end = _run(t, plus + 2, _PHONE)
    while end > plus + 3 and t[end - 1] not in _DIGITS:
        end -= 1
    return end if end > plus + 3 and t[end - 1] in _DIGITS else 0


def _in_url(c: str) -> bool:
    return not c.isspace() and c not in "\"'<>"


def _login_at(t: str, colon: int) -> Span | None:
    """A URL that carries user:password@host, around its scheme.

    What stands between a scheme and the next slash can hold no other scheme, so a text is read twice at most.
    """
    start = colon
    while start > 0 and t[start - 1] in _ALNUM:
        start -= 1
    i = stop = colon + 3
    while stop < len(t) and t[stop] != "/" and _in_url(t[stop]):
        stop += 1
    user, at, host = t[i:stop].rpartition("@")
    if not (start < colon and at and ":" in user and host and host[0] in _ALNUM):
        return None
    while stop < len(t) and _in_url(t[stop]):
        stop += 1
    return start, stop


def octet_ok(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def iban_ok(s: str) -> bool:
    rest = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in rest)) % 97 == 1


def _iban_at(t: str, i: int) -> Span | None:
    """An IBAN whose first check digit is at i: two capitals before, up to 34 characters in groups."""
    if i < 2 or not (t[i - 2] in _ALPHA and t[i - 1] in _ALPHA and t[i - 2 : i].isupper()) or (i > 2 and t[i - 3] in _ALNUM):
        return None
    end, chars = i - 2, []
    while end < len(t) and len(chars) < 34:
        if t[end] in _ALNUM and not t[end].islower():
            chars.append(t[end])
        elif not (t[end] == " " and chars and end + 1 < len(t) and t[end + 1] in _ALNUM):
            break
        end += 1
    for stop in range(end, i + 10, -1):  # a group that follows may be no part of it
        if stop < len(t) and t[stop] in _ALNUM and t[stop - 1] != " ":
            continue
        s = t[i - 2 : stop].replace(" ", "")
        if t[stop - 1] != " " and len(s) >= 15 and s[2:4].isdigit() and iban_ok(s):
            return i - 2, stop
    return None


def _ssn_at(t: str, i: int) -> Span | None:
    s = t[i : i + 11]
    ok = len(s) == 11 and s[3] == s[6] == "-" and all(c in _DIGITS for c in s[:3] + s[4:6] + s[7:])
    edge = (i == 0 or t[i - 1] not in _ALNUM and t[i - 1] != "-") and (i + 11 >= len(t) or t[i + 11] not in _ALNUM and t[i + 11] != "-")
    return (i, i + 11) if ok and edge and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else None


def _account_at(t: str, end: int) -> Span | None:
    """A number of 6 to 17 digits within 12 characters after an identifier cue."""
    i, most = end, min(len(t), end + 12)
    while i < most and t[i] not in _DIGITS:
        i += 1
    if i >= most or t[i - 1] in _ALNUM and i > end:
        return None
    stop = _run(t, i, _DIGITS)
    return (i, stop) if 6 <= stop - i <= 17 and not (stop < len(t) and t[stop] in _ALNUM) else None


def spans(t: str, cues: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """Spans of personal data by kind, in order, code points with end exclusive.

    email, ip, card and phone are the leftmost non-overlapping matches of their grammar, left to right; a match that fails
    its check is passed over whole. The cues come in the order of their ends, which is that of starts within a kind.
    """
    found: dict[str, list[Span]] = defaultdict(list)
    past = dict.fromkeys(("email", "ip", "card", "phone", "login", "run", "iban"), 0)
    for last, (kind, width) in cues.iter(t):
        at = last - width + 1
        if kind == "digit":
            if at >= past["run"]:  # the first digit of its run
                past["run"] = _run(t, at, _DIGITS)
                if at >= past["ip"] and (end := quad_at(t, at)):
                    past["ip"] = end
                    if all(map(octet_ok, t[at:end].split("."))):
                        found["ip"].append((at, end))
                if (s := _ssn_at(t, at)) is not None:
                    found["ssn"].append(s)
                if at >= past["iban"] and (s := _iban_at(t, at)) is not None:
                    past["iban"] = s[1]
                    found["iban"].append(s)
            if at >= past["card"]:
                end = past["card"] = digits_at(t, at)
                d = t[at:end].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    found["card"].append((at, end))
        elif kind == "at":
            if at >= past["email"] and (s := email_at(t, at, past["email"])) is not None:
                past["email"] = s[1]
                found["email"].append(s)
        elif kind == "plus":
            if at >= past["phone"] and (end := phone_at(t, at)):
                past["phone"] = end
                if 9 <= sum(c in _DIGITS for c in t[at:end]) <= 15:
                    found["phone"].append((at, end))
        elif kind == "scheme":
            if at >= past["login"] and (s := _login_at(t, at)) is not None:
                past["login"] = s[1]
                found["url_login"].append(s)
        elif (s := _account_at(t, last + 1)) is not None and not any(s[0] < e and b < s[1] for k in ("card", "iban", "ssn", "account") for b, e in found[k][-1:]):
            found["account"].append(s)
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cues = _automaton()
    for batch in slices(batches):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        found = [spans(t, cues) if t else {} for t in texts]
        cols = {"doc_id": ids}
        for k in KINDS:
            cols[k] = pa.array([[{"start": a, "end": b} for a, b in f.get(k, ())] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_pydict(cols)


SPAN = "array<struct<start: bigint, end: bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, by kind, the spans of personal data in the whole text (null: empty, no spans); one row per input row.

    A text of any length is read in time linear in it, as each parser goes over what it has passed a bounded number of times.
    Only doc_id and text are read, so further columns can't clash; a null doc_id stays null, repeated rows each get their
    result, an empty table gives none. There is no shuffle: a task streams its part of the scan in bounded slices.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id bigint, {', '.join(f'{k} {SPAN}' for k in KINDS)}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of every document."""
    from pyspark.sql import functions as F

    written = lambda k: F.transform(F.col(k), lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    base = F.array_join(F.concat(*(written(k) for k in KINDS[:4])), ",")
    every = F.array_join(F.concat(*(written(k) for k in KINDS)), ",")
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]]
    return find(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
