"""SentencePiece encoding and decoding by a batched numpy Viterbi over a given vocabulary.

Texts are cut into units (spaces and the word after them; no piece crosses a unit). Distinct units of equal length advance
together, one character a step: hashes of all substrings that end there probe the sorted piece keys, and the best way in is
kept with a backpointer. Keys of all ends of pieces are probed, short ones first, so a text that ends no piece goes no further. For a unigram vocabulary the best way has the largest sum of scores. For a BPE vocabulary it must
also be what merging gives: a segmentation is that of BPE exactly if BPE leaves each two adjacent pieces of it apart, so the
lattice allows only such neighbours, and one way is left. Ids equal those of the SentencePiece library for either kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from verdex.llm import textvec
from verdex.llm.common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
SPACE = "\u2581"
#: Units that a worker remembers with their ids, and neighbours that it remembers as allowed or not.
UNITS, PAIRS = 1 << 19, 1 << 20
#: Bytes of text that are encoded at once.
SLICE = 1 << 21
#: Units of more characters are cut where no piece can cross, and what is longer than WINDOW then, into windows that overlap.
LONG, WINDOW, OVERLAP = 48, 256, 64
START, UNKNOWN = -1, -2
_codecs: dict[str, Codec] = {}


@dataclass
class Vocabulary:
    """Pieces by id with their scores; plain: pieces that match text, byte_id: the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray
    byte_id: np.ndarray
    unk: int
    bpe: bool

    def codec(self) -> Codec:
        """This worker's codec of the vocabulary: it lives as long as the worker, so what it has learnt serves later tasks."""
        key = hashlib.sha256(repr((self.pieces, self.scores.tolist(), self.bpe)).encode()).hexdigest()
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = Codec(self)
        return _codecs[key]

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a .model file, on the driver; the vocabulary goes to the workers with the task, 32,000 pieces in 500 KB."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kinds = np.array([p.type for p in m.pieces])
        byte_id = np.full(256, m.trainer_spec.unk_id)
        for i in np.flatnonzero(kinds == 6):
            byte_id[int(m.pieces[i].piece[1:-1], 16)] = i
        return cls([p.piece for p in m.pieces], np.array([p.score for p in m.pieces]), kinds == 1, byte_id, m.trainer_spec.unk_id, m.trainer_spec.model_type == 2)


@dataclass
class Codec:
    """Encoder and decoder of one worker, with what it remembers."""

    v: Vocabulary
    most: int = UNITS
    units: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, _U), np.zeros(1, np.int64), np.zeros(0, np.int32)))

    def __post_init__(self) -> None:
        v = self.v
        self.of = {p: i for i, p in enumerate(v.pieces) if v.plain[i]}
        self.longest = max(map(len, self.of), default=1)
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in self.of for a, b in zip(p[:-1], p[1:], strict=True)} | {-1}), np.int64)
        ends: dict[str, int] = {}  # every end of a piece: the piece that it is itself, or -1
        for x, i in self.of.items():
            for k in range(1, len(x)):
                ends.setdefault(x[k:], -1)
            ends[x] = i
        keys = np.zeros(len(ends), _U)
        for width in range(1, self.longest + 1):
            of = np.array([k for k, x in enumerate(ends) if len(x) == width], np.int64)
            if len(of):
                text = "".join(x for x in ends if len(x) == width)
                keys[of] = self._key(np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, width).astype(_U))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(ends.values(), np.int64, len(ends))[order]
        self.near: dict[int, bool] = {}
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.whole = np.array([not v.bpe or bool(v.plain[i]) and self.merge(p) == [p] for i, p in enumerate(v.pieces)])
        self.worst = float(v.scores[v.plain].min()) - 10 if v.plain.any() else -10.0
        raw = [p.replace(SPACE, " ").encode() if v.plain[i] else b"" for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_id):
            if i != v.unk:
                raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    @staticmethod
    def _key(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), _U)
        for j in range(codes.shape[1]):
            h = h * _BASE + codes[:, j]
        return h

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the adjacent pair whose joined piece scores best is joined, the leftmost of equals, until none is left."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = self.of.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.v.scores[k] > best):
                    best, at = self.v.scores[k], i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def allowed(self, left: int, right: int) -> bool:
        """Whether right may follow left: merging leaves them apart. Nothing merges with the start or an unknown character."""
        if right == UNKNOWN:
            return True
        if left < 0 or not self.v.bpe:
            return bool(self.whole[right])
        key = left * len(self.v.pieces) + right
        if key not in self.near:
            if len(self.near) >= PAIRS // 4:
                self.near.clear()
            a, b = self.v.pieces[left], self.v.pieces[right]
            self.near[key] = self.merge(a + b) == [a, b]
        return self.near[key]

    def allowed_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """allowed() of many pairs of piece ids, through a direct-mapped table."""
        ok = self.whole[right]
        if not self.v.bpe:
            return ok
        pair = np.flatnonzero(ok & (left >= 0))
        key = left[pair] * len(self.v.pieces) + right[pair]
        slot = (textvec.mix(key.astype(_U)) & _U(PAIRS - 1)).astype(np.int64)
        out = self.pair_ok[slot]
        fresh = np.flatnonzero(self.pair_key[slot] != key)
        if len(fresh):
            new, at = np.unique(key[fresh], return_inverse=True)
            told = np.zeros(len(new), bool)
            for i, k in enumerate(new.tolist()):
                a, b = self.v.pieces[k // len(self.v.pieces)], self.v.pieces[k % len(self.v.pieces)]
                told[i] = self.merge(a + b) == [a, b]
            out[fresh] = told[at]
            self.pair_key[slot[fresh]], self.pair_ok[slot[fresh]] = key[fresh], told[at]
        ok = ok.copy()
        ok[pair] = out
        return ok

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of equally long units, a row each: (last piece, its length) at every end position."""
        n, length = codes.shape
        sums = np.zeros((n, length + 1), _U)
        for j in range(length):
            sums[:, j + 1] = sums[:, j] * _BASE + codes[:, j]
        power = np.multiply.accumulate(np.array([1] + [int(_BASE)] * self.longest, _U))
        last = np.full((n, length + 1), START, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        best = np.zeros((n, length + 1))
        for end in range(1, length + 1):
            best[:, end] = -np.inf
            rows = np.arange(n)
            for width in range(1, min(self.longest, end) + 1):
                h = sums[rows, end] - sums[rows, end - width] * power[width]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                known = self.keys[at] == h
                piece = np.where(known, self.ids[at], -1)
                if width == 1:
                    odd = rows[piece < 0]
                    best[odd, end], last[odd, end], back[odd, end] = best[odd, end - 1] + self.worst, UNKNOWN, 1
                is_piece = np.flatnonzero(piece >= 0)
                own, piece = rows[is_piece], piece[is_piece]
                ok = self.allowed_all(last[own, end - width], piece)
                own, piece = own[ok], piece[ok]
                total = best[own, end - width] + self.v.scores[piece]
                better = total >= best[own, end]  # of equal sums, the longest last piece
                own = own[better]
                best[own, end], last[own, end], back[own, end] = total[better], piece[better], width
                rows = rows[known]  # what ends no piece is the end of no longer one either
                if not len(rows):
                    break
        return last, back

    def _one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """viterbi() of a single unit: (where each piece begins, its id or UNKNOWN), in time linear in the text."""
        n = len(text)
        last, back, best = [START] * (n + 1), [0] * (n + 1), [0.0] + [-np.inf] * n
        for end in range(1, n + 1):
            for width in range(min(self.longest, end), 0, -1):  # of equal sums, the longest last piece
                k = self.of.get(text[end - width : end])
                if k is None and width > 1 or k is not None and not self.allowed(last[end - width], k):
                    continue
                total = best[end - width] + (self.worst if k is None else self.v.scores[k])
                if total > best[end]:
                    best[end], last[end], back[end] = total, UNKNOWN if k is None else k, width
        at, out = [], []
        while n:
            out.append(last[n])
            n -= back[n]
            at.append(n)
        return np.array(at[::-1], np.int64), np.array(out[::-1], np.int64)

    def _alike(self, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(where each piece begins, its id or UNKNOWN) of equally long units, a row of code points each."""
        last, back = self.viterbi(m.astype(_U))
        at, rows, taken = np.full(len(m), m.shape[1]), np.arange(len(m)), []
        while len(rows):
            width = back[rows, at[rows]]
            taken.append((rows, last[rows, at[rows]], at[rows] - width))
            at[rows] -= width
            rows = rows[at[rows] > 0]
        who, piece, pos = (np.concatenate([x[k] for x in reversed(taken)]) for k in range(3))
        order = np.lexsort((pos, who))
        who, piece, pos = who[order], piece[order], pos[order]
        cuts = np.searchsorted(who, np.arange(len(m) + 1))
        return [(pos[i:j], piece[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _pieces(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(where each piece begins, its id or UNKNOWN) of units, given as bounds in an array of code points."""
        out: list = [None] * len(start)
        size = end - start
        for length in np.unique(size):
            group = np.flatnonzero(size == length)
            if len(group) < 8:
                for i in group:
                    out[i] = self._one("".join(map(chr, codes[start[i] : end[i]])))
                continue
            for i in range(0, len(group), 1 << 15):
                part = group[i : i + (1 << 15)]
                for k, got in zip(part, self._alike(codes[start[part][:, None] + np.arange(length)]), strict=True):
                    out[k] = got
        return out

    def _long(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each piece begins, its id or UNKNOWN) of one long unit.

        It is cut between characters that stand beside each other in no piece. Of BPE, a part that is still long goes in
        windows that overlap: two neighbours are joined at a place where both begin a piece and BPE leaves the two pieces
        there apart, so all adjacent pieces of the whole are such as BPE leaves apart, which only its own are. Without such a
        place, and for other vocabularies, the part is encoded in one go.
        """
        pair = codes[:-1].astype(np.int64) << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        apart = np.flatnonzero(self.beside[at] != pair) + 1
        ahead = np.searchsorted(apart, apart + LONG // 2)  # from each cut, the next one that leaves half of LONG characters between
        edge, k = [0], int(np.searchsorted(apart, LONG // 2))
        while k < len(apart):
            edge.append(int(apart[k]))
            k = int(ahead[k])
        edge.append(len(codes))
        parts: list[tuple[int, int]] = []
        runs: list[tuple[int, int]] = []  # of parts[], those that are windows of one part
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            first = len(parts)
            if j - i > WINDOW and self.v.bpe:
                begins = range(i, j - OVERLAP, WINDOW - OVERLAP)
                parts += [(b, min(b + WINDOW, j)) for b in begins]
            else:
                parts.append((i, j))
            if len(parts) > first + 1:
                runs.append((first, len(parts)))
        cut = np.array(parts)
        got = self._pieces(codes, cut[:, 0], cut[:, 1])
        got = [(a + at, piece) for (a, _), (at, piece) in zip(parts, got, strict=True)]
        for first, stop in runs:
            keep = [[0, len(x[0])] for x in got[first:stop]]
            for k in range(first, stop - 1):
                (a, left), (b, right) = got[k], got[k + 1]
                for p in np.intersect1d(a, b)[::-1]:
                    i, j = np.searchsorted(a, p), np.searchsorted(b, p)
                    if i > keep[k - first][0] and left[i - 1] != UNKNOWN != right[j] and self.allowed(int(left[i - 1]), int(right[j])):
                        keep[k - first][1], keep[k + 1 - first][0] = i, j
                        break
                else:
                    at, piece = self._one("".join(map(chr, codes[parts[first][0] : parts[stop - 1][1]])))
                    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    got[first:stop] = [(parts[first][0] + at, piece), *[none] * (stop - first - 1)]
                    break
            else:
                got[first:stop] = [(at[i:j], piece[i:j]) for (at, piece), (i, j) in zip(got[first:stop], keep, strict=True)]
        return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])

    def _fresh(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of distinct units, given as bounds in an array of code points."""
        short = np.flatnonzero(end - start <= LONG)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(start)
        each = zip(short, self._pieces(codes, start[short], end[short]), strict=True)
        for k, (at, piece) in [*each, *((k, self._long(codes[start[k] : end[k]])) for k in np.flatnonzero(end - start > LONG))]:
            if (piece < 0).any():
                known = piece >= 0
                raw = [self.v.byte_id[list(chr(c).encode())] for c in codes[start[k] + at[~known]].tolist()]
                size = np.ones(len(piece), np.int64)
                size[~known] = [len(x) for x in raw]
                ends = np.cumsum(size)
                ids = np.empty(ends[-1], np.int64)
                ids[(ends - size)[known]] = piece[known]
                ids[ragged((ends - size)[~known], size[~known])] = np.concatenate(raw)
                piece = ids
            out[k] = piece.astype(np.int32)
        return out

    def encode(self, col: pa.Array) -> pa.ListArray:
        """The ids of each text; null and empty texts have none."""
        text = pa.compute.replace_substring(pa.compute.fill_null(col.cast(pa.large_string()), ""), SPACE, " ")
        none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        buf, off = textvec.utf8(pa.compute.if_else(pa.compute.equal(text, none), text, pa.compute.binary_join_element_wise(space, text, none)))
        n = len(buf)
        if not n:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(off)), pa.int32()), pa.array([], pa.int32()))
        space = buf == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[off[:-1][off[1:] > off[:-1]]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)
        h = textvec.span_hashes(buf, start, end)
        first_of, of = np.unique(h, return_index=True, return_inverse=True)[1:]
        keys = h[first_of]
        known, at, values = self.units
        pos = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        new = known[pos] != keys if len(known) else np.ones(len(keys), bool)
        if new.any():
            codes = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
            codes = np.where(codes == 0x20, np.uint32(ord(SPACE)), codes)
            char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            fresh = first_of[new]
            ids = self._fresh(codes, char[start[fresh]], char[end[fresh]])
            if len(known) + len(ids) > self.most:  # forget what earlier slices had, but not this one's
                old = np.unique(pos[~new])
                kept = [values[at[i] : at[i + 1]] for i in old]
                all_keys, lists = np.concatenate([known[old], keys[new]]), kept + ids
                order = np.argsort(all_keys)
                known = all_keys[order]
                sizes = np.array([len(x) for x in lists])[order]
                at = np.concatenate([[0], np.cumsum(sizes)])
                values = np.concatenate([lists[i] for i in order])
            else:
                more = np.concatenate(ids)
                starts = np.concatenate([at[:-1], len(values) + np.cumsum([0] + [len(x) for x in ids[:-1]])])
                sizes = np.concatenate([np.diff(at), [len(x) for x in ids]]).astype(np.int64)
                all_keys, pool = np.concatenate([known, keys[new]]), np.concatenate([values, more])
                order = np.argsort(all_keys)
                known, sizes = all_keys[order], sizes[order]
                at = np.concatenate([[0], np.cumsum(sizes)])
                values = pool[ragged(starts[order], sizes)]
            self.units = (known, at, values)
            pos = np.searchsorted(known, keys)
        at0, sizes = at[pos][of], (at[pos + 1] - at[pos])[of]
        flat = values[ragged(at0, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.searchsorted(start, off)]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids: pieces joined, byte pieces as bytes, without the space that encoding put first."""
        flat = pa.compute.fill_null(ids.flatten(), self.v.unk).to_numpy(zero_copy_only=False)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        width = (self.raw_at[1:] - self.raw_at[:-1])[flat]
        data = self.raw[ragged(self.raw_at[flat], width)]
        bounds = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
        texts = [data[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.array([(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts], pa.string())


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... of size[i] each, one after another."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - at, size)


def encode(docs: DataFrame, vocabulary: Vocabulary, out: str = "ids", most: int = UNITS // 2) -> DataFrame:
    """docs with the ids of its column text as an array column `out` (an existing column of that name is replaced).

    A null or empty text has an empty array. White space is kept; U+2581 counts as a space, as in the library. Rows repeat
    and tie freely; an empty table gives no rows. No shuffle; a task streams slices and remembers `most` units:
    half of what a pass on its own takes, as this one shares its executors' memory with what stands before it.
    """
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        codec.most = most
        for b in slices(batches, most=SLICE // 2):
            ids = codec.encode(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the text of its array column `ids` as column `out` (replaced if it exists).

    Null or empty ids give an empty text; rows repeat freely, an empty table gives no rows, and slices bound the ids held.
    """
    kept = encoded.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for b in slices(batches, ids):
            yield pa.RecordBatch.from_arrays([*b.columns, codec.decode(b.column(b.schema.get_field_index(ids)))], names=[*b.schema.names, out])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256 (ids as little-endian int32), decoded_sha256, round_trip.

    round_trip: the decoded text is the original, in which U+2581 counts as a space. One row per input row; null is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        codec.most = UNITS
        for b in slices(batches, most=SLICE):
            ids = codec.encode(b.column(1))
            flat, off = ids.values.to_numpy(zero_copy_only=False).astype("<i4"), ids.offsets.to_numpy()
            told = [hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(off[:-1], off[1:], strict=True)]
            text = codec.decode(ids)
            same = pa.compute.equal(text, pa.compute.replace_substring(pa.compute.fill_null(b.column(1), ""), SPACE, " "))
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(told), pa.array(digest), same], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), Vocabulary.load(model))
