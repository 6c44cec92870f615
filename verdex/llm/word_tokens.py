"""Token ids of texts by a `tokenizers` vocabulary file, each distinct word of a slice of texts encoded once.

A file whose rules cut at white space and at letters, digits and signs (normalised by NFC, white space and lower case; BPE
with word ends) takes the quick way: words of Latin characters are cut and merged in numpy, many at once. Other words go to
the library, and so do whole texts of any other file. Ids equal the library's in every case.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points below this are cut and lower-cased by table; NFC leaves them as they are.
LATIN = 0x250
#: The longest unit, in bytes, that is merged in numpy.
LONGEST = 40
#: Units that a worker remembers with their ids.
UNITS = 1 << 18
NONE = 1 << 30
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... of size[i] each, one after another."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size) if total else np.zeros(0, np.int64)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _quick(spec: dict) -> bool:
    """Whether the file's rules are those that the quick way follows."""
    parts = spec.get("normalizer") or {}
    kinds = [x.get("type") for x in parts.get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (splits[0]["behavior"], splits[0]["invert"], splits[1]["add_prefix_space"], splits[1]["use_regex"]) == ("Removed", True, False, False)
        and (model["type"], model["end_of_word_suffix"], model["dropout"], model["ignore_merges"]) == ("BPE", "</w>", None, False)
        and not any(x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"]) for x in spec["added_tokens"])
    )


class Encoder:
    """The ids of texts; up to UNITS units are remembered from one slice to the next."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.quick = _quick(spec)
        if not self.quick:
            return
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        names = _byte_names()
        self.byte_id = np.array([vocab[names[b]] for b in range(256)])
        self.last_id = np.array([vocab[names[b] + end] for b in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs])
        made = np.array([vocab[a + b] for a, b in pairs])
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made
        # a first table by hash, as most pairs that are asked for don't merge: a bit of each key's hash
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(keys)] = True
        marks = {c for x in spec["added_tokens"] for c in x["content"][:1]}
        kind = np.zeros(LATIN, np.uint8)  # 1 letters, 2 numbers, 3 other signs, 0: the library's
        low = np.arange(LATIN)
        for c in range(LATIN):
            x = chr(c)
            y = x.lower()
            if x.isspace() or x == "'" or x in marks or len(y) > 1 or ord(y) >= 0x800 or c < 32 or c == 127:
                continue
            kind[c], low[c] = {"L": 1, "N": 2}.get(unicodedata.category(x)[0], 3), ord(y)
        self.kind, self.low = kind, low
        self.known, self.ids, self.bounds = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 11) & ((1 << 22) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE without one."""
        key = (left << 20) | right
        out = np.full(key.shape, NONE)
        maybe = np.flatnonzero(self.seen[self._slot(key)])
        k = key.ravel()[maybe]
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[at] == k
        out.ravel()[maybe[hit]] = self.rank[at[hit]]
        return out

    def merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of equally long units, a row of ids each: (ids, sizes). The pair of least rank is merged, the leftmost of equals."""
        n, length = ids.shape
        out, sizes = ids.copy(), np.full(n, length)
        rows, t = np.arange(n), ids.copy()
        r = np.concatenate([self.ranks(t[:, :-1], t[:, 1:]), np.full((n, 1), NONE)], 1)
        while len(rows):
            j = r.argmin(1)
            best = r[np.arange(len(rows)), j]
            over = best == NONE
            if over.any():
                out[rows[over], : t.shape[1]], sizes[rows[over]] = t[over], t.shape[1]
                go = ~over
                rows, t, r, j, best = rows[go], t[go], r[go], j[go], best[go]
                if not len(rows):
                    break
            each, width = np.arange(len(rows)), t.shape[1] - 1
            at = np.arange(width)
            take = at + (at > j[:, None])
            t[each, j] = self.made[best]
            t, r = np.take_along_axis(t, take, 1), np.take_along_axis(r, take, 1)
            has = np.flatnonzero(j > 0)
            r[has, j[has] - 1] = self.ranks(t[has, j[has] - 1], t[has, j[has]])
            r[each, j] = NONE
            has = np.flatnonzero(j < width - 1)
            r[has, j[has]] = self.ranks(t[has, j[has]], t[has, j[has] + 1])
        return out, sizes

    def units(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct units: new ones are merged and remembered; what is remembered goes when there is no room."""
        at = pc.fill_null(pc.index_in(col, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = col.take(pa.array(new))
            ids, bounds = self.fresh(fresh)
            if len(self.known) + len(new) > UNITS:
                told = np.flatnonzero(at >= 0)
                ids = np.concatenate([self.ids[ragged(self.bounds[at[told]], np.diff(self.bounds)[at[told]])], ids])
                bounds = _bounds(np.concatenate([np.diff(self.bounds)[at[told]], np.diff(bounds)]))
                self.known, self.ids, self.bounds = pa.concat_arrays([col.take(pa.array(told)), fresh]), ids, bounds
                at[told] = np.arange(len(told))
            else:
                self.known, self.ids = pa.concat_arrays([self.known, fresh]), np.concatenate([self.ids, ids])
                self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
            at[new] = np.arange(len(self.known) - len(new), len(self.known))
        sizes = np.diff(self.bounds)[at]
        return self.ids[ragged(self.bounds[at], sizes)], _bounds(sizes)

    def fresh(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct units, given in lower case."""
        buf, off = _utf8(col)
        size = np.diff(off)
        order = np.argsort(size, kind="stable")
        parts, told = [], np.zeros(len(col), np.int64)
        edges = np.searchsorted(size[order], np.arange(1, (int(size.max()) if len(size) else 0) + 2))
        for length, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
            for i in range(a, b, 1 << 15):
                group = order[i : min(b, i + (1 << 15))]
                raw = buf[off[group][:, None] + np.arange(length)]
                ids = self.byte_id[raw]
                ids[:, -1] = self.last_id[raw[:, -1]]
                ids, told[group] = self.merge(ids)
                parts.append(ids[np.arange(length) < told[group][:, None]])
        starts = np.zeros(len(col), np.int64)
        starts[order] = _bounds(told[order])[:-1]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return flat[ragged(starts, told)].astype(np.uint32), _bounds(told)

    def words(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words without ASCII white space inside."""
        buf, off = _utf8(col)
        code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
        kind = np.where(code < LATIN, self.kind[np.minimum(code, LATIN - 1)], 0)
        word = np.repeat(np.arange(len(col)), np.diff(bounds))
        odd = np.zeros(len(col), bool)
        odd[word[kind == 0]] = True
        inside = ~odd[word]
        code, kind, word = self.low[code[inside]], kind[inside], word[inside]
        begin = np.ones(len(code), bool)
        begin[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start = np.flatnonzero(begin)
        two = code >= 0x80
        at = np.cumsum(1 + two) - (1 + two)
        raw = np.zeros(len(code) + int(two.sum()), np.uint8)
        raw[at] = np.where(two, 0xC0 | code >> 6, code)
        raw[at[two] + 1] = 0x80 | code[two] & 0x3F
        ends = np.append(at[start], len(raw)).astype(np.int32)
        of = word[start]
        long = np.zeros(len(col), bool)
        long[of[np.diff(ends) > LONGEST]] = True
        unit = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).filter(pa.array(~long[of])).dictionary_encode()
        of = of[~long[of]]
        ids, cut = self.units(unit.dictionary)
        index = unit.indices.to_numpy()
        sizes = np.diff(cut)[index]
        library = np.flatnonzero(odd | long)
        rest = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(col.take(pa.array(library)).to_pylist(), add_special_tokens=False)]
        total = np.bincount(of, sizes, len(col)).astype(np.int64)
        total[library] = [len(x) for x in rest]
        ends = _bounds(total)
        out = np.zeros(ends[-1], np.uint32)
        mine = ~(odd | long)
        out[ragged(ends[:-1][mine], total[mine])] = ids[ragged(cut[index], sizes)]
        if len(library):
            out[ragged(ends[library], total[library])] = np.concatenate(rest)
        return out, ends

    def encode(self, col: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of all texts, null as the empty text, `end` after each where it is given."""
        col = pc.fill_null(col, "")
        if not self.quick:
            told = [np.array(x.ids + ([] if end is None else [end]), np.uint32) for x in self.library.encode_batch_fast(col.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *told]), _bounds(np.array([len(x) for x in told], np.int64))
        lists = pc.ascii_split_whitespace(col)
        seen = lists.flatten().dictionary_encode()
        ids, at = self.words(seen.dictionary)
        index = seen.indices.to_numpy()
        sizes = np.diff(at)[index]
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total = _bounds(sizes)[first]
        if end is None:
            return ids[ragged(at[index], sizes)], total
        bounds = total + np.arange(len(total))
        out = np.full(bounds[-1], end, np.uint32)
        out[ragged(bounds[:-1], np.diff(bounds) - 1)] = ids[ragged(at[index], sizes)]
        return out, bounds


def _utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from verdex.llm import textvec

    return textvec.utf8(col)
