"""Removal of long repeats with run-length indexes over content-dealt pieces of the corpus.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with
a smaller id. One index of a large corpus fits no task, so strings are dealt by content:

1. *Dealing.* The anchor of a string is the GRAM-byte string in it with the smallest hash
   (the first, if several), so equal strings have equal anchors wherever they stand.
   Blocks of documents send their distinct anchors, sorted, to the part of the hash range
   they belong to; an anchor is kept if two documents hold it.
2. *Rows.* Consecutive strings with one anchor make one row: what stands before the
   anchor, the anchor, what follows. Equal rows of a block are one run, sampled at its
   first end: the smallest id. Rows go to the part of their anchor. The strings of an
   anchor that stands in very many places (``hot``) are rows of their own, dealt by all
   their bytes: within a block equal ones fold, and the others spread, so neither copies
   nor a common passage in changing surroundings fill one part.
3. *Run-length index.* A part sorts the suffixes that begin at the anchors; the bytes
   before them are a Burrows-Wheeler column, kept as runs of equal bytes. LF mapping moves
   whole runs to the order of the suffixes one byte longer; common prefixes grow by one
   inside a run, and only at run heads is a minimum over the runs between looked up. So
   each row is streamed backwards through the index, and after each byte the matching
   statistics tell which rows share ``length`` bytes; the smallest id among their samples
   is passed back. All comparisons are of bytes; hashes only deal.
4. A block marks the strings that a smaller id holds and joins marks to maximal spans.

No rows are dropped or capped; ``hot`` changes how strings are dealt, not the result.

Defined cases: null text is empty; matches never cross documents; a null doc_id neither
loses bytes nor makes others lose them; rows that share an id never take from each other
and each give a row; texts under ``length`` bytes stay whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_bytes

GRAM = 24
CHUNK = 1 << 20
SHARE = 1 << 16
"""Rows that a part indexes in one step."""
HOT = 1 << 12
"""Places of an anchor from which on its strings are dealt one by one."""
LEAST_BLOCKS = 48
NOWHERE = np.iinfo(np.int64).max

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_ODD = _rng.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
del _rng


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[200]
    return h ^ (h >> np.uint64(29))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place of the last axis (24 = 16 + 8, by doubling)."""
    h = _BYTE[b]
    for i, w in enumerate((1, 2, 4)):
        h = h[..., :-w] * _ODD[i] + h[..., w:]
    eight = h
    h = h[..., :-8] * _ODD[3] + h[..., 8:]
    return _mix(h[..., :-8] * _ODD[4] + eight[..., 16:])


def _dealt(h: np.ndarray) -> np.ndarray:
    """By which an anchor is dealt: the smallest hashes lie close together, so they are mixed once more; 48 bits are enough to tell most apart."""
    return _mix(h * _ODD[8]) & ~np.uint64(0xFFFF)


def _slide(h: np.ndarray, width: int, least) -> np.ndarray:
    """least over each ``width`` consecutive values."""
    w = 1
    while 2 * w <= width:
        h = least(h[:-w], h[w:])
        w *= 2
    return least(h[: len(h) - (width - w)], h[width - w :]) if width > w else h


def anchors(b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors, and the first and last string of each; ``width`` grams make a string."""
    if len(b) < GRAM + width - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(b)
    # the place in the low bits: of grams alike in the high ones the first is the smallest
    low = np.uint64((1 << 22) - 1)
    at = (_slide((h & ~low) | np.arange(len(h), dtype=np.uint64), width, np.minimum) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], _dealt(h[at[first]]), first, np.r_[first[1:], len(at)] - 1


def text_anchors(b: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``anchors`` in chunks of strings, so that memory stays bounded; an anchor of two chunks stands twice."""
    if len(b) <= CHUNK + GRAM + width:
        return anchors(b, width)
    found = []
    for s in range(0, len(b) - GRAM - width + 2, CHUNK):
        at, h, first, last = anchors(b[s : s + CHUNK + GRAM + width - 2], width)
        found.append((at + s, h, first + s, last + s))
    return tuple(np.concatenate(x) for x in zip(*found))


_zip = lambda *arrays: zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _bytes_apart(x: np.ndarray) -> np.ndarray:
    """64-bit numbers byte plane after byte plane: most high planes are zero."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)


def _joined(raw, n: int, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(kind)[:, 0]


def _planes(h: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, byte plane after byte plane."""
    return _bytes_apart(np.diff(h, prepend=np.uint64(0)))


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_joined(raw, n), dtype=np.uint64)


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _cuts(h: np.ndarray, parts: int) -> np.ndarray:
    """Where the equal parts of the hash range begin in sorted hashes."""
    edges = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    return np.r_[np.searchsorted(h, edges), len(h)]


class Block:
    """The documents of a block in a fixed order, and their anchors."""

    def __init__(self, docs: pd.DataFrame, width: int, carry: list[str] = ()):
        docs = docs.sort_values(["doc_id", "orphan", "text"], kind="stable", na_position="last")
        self.ids, self.orphan = docs["doc_id"].to_numpy(np.int64), docs["orphan"].to_numpy(bool)
        self.texts = [(x or "").encode() if isinstance(x, str) else b"" for x in docs["text"]]
        self.carried = list(docs[list(carry)].astype(object).itertuples(index=False, name=None)) if carry else [()] * len(docs)
        self.width = width

    def found(self) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        for i, (orphan, raw) in enumerate(zip(self.orphan, self.texts)):
            if orphan or len(raw) < GRAM + self.width - 1:
                continue
            b = np.frombuffer(raw, np.uint8)
            yield i, b, text_anchors(b, self.width)


def _own_anchors(width: int, parts: int):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        block = Block(docs, width)
        hashes, owners = [], []
        for i, _, (_, h, _, _) in block.found():
            hashes.append(h)
            owners.append(np.full(len(h), block.ids[i], np.int64))
        if not hashes:
            return pd.DataFrame({"part": [], "block": [], "n": [], "blob": []})
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        places = np.minimum(np.diff(np.r_[start, len(h)]), 65535).astype(np.uint16)
        h, rows = h[start], []
        cuts = _cuts(h, parts)
        for p in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[p], cuts[p + 1])
            rows.append((p, key[0], len(h[s]), _zip(_planes(h[s]), places[s], several[s])))
        give_back()
        return pd.DataFrame(rows, columns=["part", "block", "n", "blob"])

    return run


def _shared_anchors(hot: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Back to each block: those of its anchors that two documents hold, and which of them are hot."""
        hashes, places, several = [], [], []
        for n, blob in zip(rows["n"], rows["blob"]):
            raw = _unzip(blob)
            hashes.append(_unplanes(raw[: 8 * n], n))
            places.append(np.frombuffer(raw[8 * n : 10 * n], np.uint16))
            several.append(np.frombuffer(raw[10 * n :], bool))
        h, n_places, flag = np.concatenate(hashes), np.concatenate(places), np.concatenate(several)
        order = np.argsort(h, kind="stable")
        sorted_ = h[order]
        start = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        count = np.diff(np.r_[start, len(h)])
        shared = (count > 1) | np.logical_or.reduceat(flag[order], start)
        many = np.add.reduceat(n_places[order].astype(np.int64), start) >= hot
        keep, is_hot = np.empty(len(h), bool), np.empty(len(h), bool)
        keep[order], is_hot[order] = np.repeat(shared, count), np.repeat(many, count)
        out, at = [], 0
        for block, own in zip(rows["block"], hashes):
            s = slice(at, at + len(own))
            at += len(own)
            mine = own[keep[s]]
            if len(mine):
                out.append((block, len(mine), _zip(_planes(mine), is_hot[s][keep[s]])))
        give_back()
        return pd.DataFrame(out, columns=["block", "n", "blob"])

    return run


class Rows:
    """Rows of bytes, the smallest id of each, and from how many to how many bytes before the anchor its strings begin."""

    def __init__(self, rows: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.rows, self.least, self.low, self.high = rows, least, low, high

    def __len__(self) -> int:
        return len(self.least)

    def __getitem__(self, s) -> Rows:
        return Rows(self.rows[s], self.least[s], self.low[s], self.high[s])

    def pack(self) -> bytes:
        return _zip(_bytes_apart(self.least), self.low, self.high, self.rows)

    @classmethod
    def unpack(cls, blob: bytes, n: int) -> Rows:
        raw = np.frombuffer(_unzip(blob), np.uint8)
        return cls(raw[10 * n :].reshape(n, -1), _joined(raw[: 8 * n], n, np.int64), raw[8 * n : 9 * n], raw[9 * n : 10 * n])

    @classmethod
    def together(cls, parts: list[Rows]) -> Rows:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("rows", "least", "low", "high")))

    def keys(self, width: int) -> np.ndarray:
        """Hashes of the anchors; a row of one string begins with it, and that of its first bytes will do."""
        out = np.empty(len(self), np.uint64)
        for s in range(0, len(self), 1 << 14):
            out[s : s + (1 << 14)] = _dealt(gram_hashes(self.rows[s : s + (1 << 14), width - 1 : width - 1 + GRAM])[:, 0])
        return out


def _pieces(b: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes: up to width - 1 before each anchor, the anchor, up to width - 1 after; zeros beyond the strings."""
    before = width - 1
    padded = np.concatenate([np.zeros(before, np.uint8), b, np.zeros(before, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, 2 * before + GRAM)[at]
    place = np.arange(2 * before + GRAM, dtype=np.uint8)
    for s in range(0, len(at), 1 << 14):
        lo, hi = (x[s : s + (1 << 14), None].astype(np.uint8) for x in (low, high))
        rows[s : s + (1 << 14)][(place < before - hi) | (place >= GRAM + 2 * before - lo)] = 0
    return rows


def _rows(width: int, parts: int):
    """Rows to the parts of the hash range, their places to the block itself."""

    def run(key: tuple, docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"dest": [], "block": [], "n": [], "blob": []})
        if not len(docs) or not len(shared):
            return none
        raws = [(n, _unzip(b)) for n, b in zip(shared["n"], shared["blob"])]
        kept = np.concatenate([_unplanes(raw[: 8 * n], n) for n, raw in raws])
        is_hot = np.concatenate([np.frombuffer(raw[8 * n :], bool) for n, raw in raws])
        order = np.argsort(kept)
        kept, is_hot = kept[order], is_hot[order]
        del raws
        block = Block(docs, width)
        pieces = []
        for i, b, (at, h, first, last) in block.found():
            found = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
            hit = kept[found] == h
            if not hit.any():
                continue
            at, h, first, last, hot = at[hit], h[hit], first[hit], last[hit], is_hot[found[hit]]
            low, high = at - last, at - first
            if hot.any():  # each string is a row of its own, and begins it
                n = (last - first + 1)[hot]
                begin = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                zero = np.zeros(len(begin), np.int64)
                at, low, high = (np.concatenate([x[~hot], y]) for x, y in ((at, begin), (low, zero), (high, zero)))
                h = np.concatenate([h[~hot], zero.astype(np.uint64)])
            rows = _pieces(b, at, low, high, width)
            if hot.any():
                h[len(h) - len(begin) :] = _fold(rows[len(h) - len(begin) :], _ODD[6])
            pieces.append((np.full(len(at), i, np.int32), at, h, low.astype(np.uint8), high.astype(np.uint8), rows))
        if not pieces:
            return none
        doc, at, dealt, low, high, rows = (np.concatenate(x) for x in zip(*pieces))
        del pieces
        ids = block.ids[doc]
        alike = _mix(_fold(rows, _ODD[5]) + (low * np.uint64(64) + high) * _ODD[7])
        order = np.lexsort((alike, dealt))
        some = rows[order]
        del rows
        new = np.ones(len(order), bool)
        for x in (dealt, alike, low, high):
            x = x[order]
            new[1:] &= x[1:] == x[:-1]
        for s in range(1, len(order), 1 << 16):
            end = min(s + (1 << 16), len(order))
            new[s:end] &= (some[s:end] == some[s - 1 : end - 1]).all(axis=1)
        new[1:] = ~new[1:]
        start = np.flatnonzero(new)
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new) - 1
        first = order[start]
        made = Rows(some[start], np.minimum.reduceat(ids[order], start), low[first], high[first])
        cuts = _cuts(dealt[first], parts)
        out = []
        for p in np.flatnonzero(np.diff(cuts)):
            out.append((int(p), key[0], int(cuts[p + 1] - cuts[p]), made[cuts[p] : cuts[p + 1]].pack()))
        places = (doc, at.astype(np.int32 if at.max() < 2**31 else np.int64), number)
        out.append((parts + key[0], key[0], len(at), _zip(*places, made.least, made.low, made.high, cuts.astype(np.int64))))
        del some, made
        give_back()
        return pd.DataFrame(out, columns=["dest", "block", "n", "blob"])

    return run


def _fold(rows: np.ndarray, odd: np.uint64) -> np.ndarray:
    """A hash of all bytes of each row, eight at a time."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8)), np.uint64)
    words.view(np.uint8)[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for c in range(words.shape[1]):
        h = _mix(h * odd + words[:, c])
    return h


class RunLengthIndex:
    """The suffixes of a part's rows that begin a given number of bytes before the anchors, in order.

    ``order`` lists rows by their suffix, ``common`` how many bytes each has in common with the one before.
    """

    def __init__(self, rows: np.ndarray, width: int):
        self.columns = np.ascontiguousarray(rows.T)
        self.back = width - 1  # bytes before the anchor
        tail = np.ascontiguousarray(rows[:, self.back :])
        self.order = np.argsort(tail.view(f"S{tail.shape[1]}").ravel(), kind="stable")
        tail = tail[self.order]
        other = tail[1:] != tail[:-1]
        self.common = np.r_[0, np.where(other.any(axis=1), other.argmax(axis=1), tail.shape[1])].astype(np.int16)
        self.runs = 0

    def extend(self) -> None:
        """LF mapping: to the suffixes that begin one byte earlier, run by run."""
        self.back -= 1
        column = self.columns[self.back][self.order]
        head = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        size = np.diff(np.r_[head, len(column)])
        self.runs += len(head)
        byte = column[head]
        to = np.argsort(byte, kind="stable")  # runs in their new order
        begin = np.cumsum(size[to]) - size[to]
        moved = np.repeat(head[to] - begin, size[to]) + np.arange(len(column))
        common = self.common[moved] + np.int16(1)
        # a run's head follows the end of the run before it with the same byte
        same = np.flatnonzero(byte[to][1:] == byte[to][:-1]) + 1
        common[begin] = 0
        if len(same):
            run, last = to[same], to[same - 1]
            least = _range_minima(np.minimum.reduceat(self.common, head), last + 1, run)
            common[begin[same]] = np.minimum(least, self.common[head[run]]) + 1
        self.order, self.common = self.order[moved], common


def _range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Smallest of values[start:stop] for each pair; no range is empty."""
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(values[start[own]], values[stop[own] - (1 << k)])
        if len(values) > 1 << k:
            values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def matching(r: Rows, width: int, length: int) -> np.ndarray:
    """For each row a bit for each number of bytes before the anchor: does a row with a smaller id have the same string there?"""
    found = np.zeros(len(r), np.uint64)
    index = RunLengthIndex(r.rows, width)
    for a in range(width):
        if a:
            index.extend()
        order = index.order
        valid = (r.low[order] <= a) & (a <= r.high[order])
        least = r.least[order]
        start = np.flatnonzero(np.r_[True, index.common[1:] < length])
        low = np.minimum.reduceat(np.where(valid, least, NOWHERE), start)
        low = np.repeat(low, np.diff(np.r_[start, len(order)]))
        found[order[valid & (low < least)]] |= np.uint64(1 << a)
    return found


def _statistics(width: int, parts: int, length: int):
    """Back to the blocks: for each of their rows the strings that a smaller id of another holds."""

    def run(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        dest = int(key[0])
        if dest >= parts:  # places on their way back to the block
            return pd.DataFrame({"block": blobs["block"], "part": -1, "n": blobs["n"], "blob": blobs["blob"]})
        made = [Rows.unpack(blob, n) for n, blob in zip(blobs["n"], blobs["blob"])]
        found = [[] for _ in made]
        # a share of the keys at a time
        steps = -(-sum(map(len, made)) // SHARE)
        share = [(x.keys(width) >> np.uint64(16)) % np.uint64(steps) if steps > 1 else np.zeros(len(x), np.uint64) for x in made]
        for step in range(steps):
            own = [np.flatnonzero(x == step) for x in share]
            bits = matching(Rows.together([x[s] for x, s in zip(made, own)]), width, length)
            at = 0
            for out, s in zip(found, own):
                hit = np.flatnonzero(bits[at : at + len(s)])
                out.append((s[hit].astype(np.int32), bits[at + hit]))
                at += len(s)
        out = []
        for block, x in zip(blobs["block"], found):
            if not x:
                continue
            hit, bits = (np.concatenate(y) for y in zip(*x))
            if len(hit):
                out.append((block, dest, len(hit), _zip(hit, bits)))
        del made, found
        give_back()
        return pd.DataFrame(out, columns=["block", "part", "n", "blob"])

    return run


def _removal(width: int, parts: int, length: int, keep_text: bool, carry: list[str]):
    columns = ["doc_id", "orphan", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] * keep_text), *carry]

    def run(key: tuple, docs: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c: [] for c in columns})
        block = Block(docs, width, carry)
        starts: dict[int, np.ndarray] = {}
        occ = back[back["part"] < 0]
        if len(occ):
            n, raw = int(occ["n"].iloc[0]), _unzip(occ["blob"].iloc[0])
            cuts = np.frombuffer(raw[-8 * (parts + 1) :], np.int64)
            n_rows = int(cuts[-1])
            wide = (len(raw) - 8 * (parts + 1) - 10 * n_rows) // n - 8
            take = iter(np.split(np.frombuffer(raw, np.uint8), np.cumsum([4 * n, wide * n, 4 * n, 8 * n_rows, n_rows, n_rows])))
            doc, at, number, least, low, high = (next(take).view(t) for t in (np.int32, np.int32 if wide == 4 else np.int64, np.int32, np.int64, np.uint8, np.uint8))
            bits = np.zeros(n_rows, np.uint64)
            for p, m, blob in zip(back["part"], back["n"], back["blob"]):
                if p >= 0:
                    raw = _unzip(blob)
                    bits[cuts[p] + np.frombuffer(raw[: 4 * m], np.int32)] = np.frombuffer(raw[4 * m :], np.uint64)
            # a smaller id has the string elsewhere, or the row itself stands in one
            hit = np.flatnonzero((bits[number] > 0) | (least[number] < block.ids[doc]))
            ahead = np.arange(width)
            for s in range(0, len(hit), 1 << 16):
                some = hit[s : s + (1 << 16)]
                d, own = doc[some], number[some]
                begin = at[some].astype(np.int64)[:, None] - ahead
                mark = (least[own] < block.ids[d])[:, None] | ((bits[own][:, None] >> ahead.astype(np.uint64)) & np.uint64(1)).astype(bool)
                mark &= (low[own][:, None] <= ahead) & (ahead <= high[own][:, None])
                i, a = np.nonzero(mark)
                found = begin[i, a]
                who = d[i]
                order = np.argsort(who, kind="stable")
                who, found = who[order], found[order]
                edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else []
                for x, y in zip(edge, [*edge[1:], len(who)]):
                    k = int(who[x])
                    starts[k] = np.concatenate([starts[k], found[x:y]]) if k in starts else found[x:y]
        out = []
        for i, (doc_id, orphan, raw) in enumerate(zip(block.ids, block.orphan, block.texts)):
            removed = spans = 0
            kept = raw
            if i in starts:
                cover = np.zeros(len(raw) + 1, np.int32)
                first = np.unique(starts[i])
                np.add.at(cover, first, 1)
                np.add.at(cover, first + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = int(gone.sum())
                spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            text = [kept.decode("utf-8", "ignore")] * keep_text
            out.append((doc_id, orphan, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), *text, *block.carried[i]))
        starts.clear()
        give_back()
        return pd.DataFrame(out, columns=columns)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 6 << 20, keep_text: bool = False, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, with ``keep_text`` also the kept text
    (a character that lost a byte goes), and the string columns named in ``carry``.

    One plan: the exchange of documents by block is made once and reused.
    """
    width = length - GRAM + 1
    if not 2 <= width <= 64:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 63}")
    # by bytes alone: each block passes on one piece to each part
    blocks = max(-(-text_bytes(docs) // block_bytes), LEAST_BLOCKS)
    parts = max(blocks // 2, LEAST_BLOCKS // 2)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(blocks)).cast("int").alias("block"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("orphan"), "text", *carry)
    own = dealt.groupBy("block").applyInPandas(_own_anchors(width, parts), "part int, block int, n long, blob binary")
    shared = own.groupBy("part").applyInPandas(_shared_anchors(hot), "block int, n long, blob binary")
    rows = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_rows(width, parts), "dest int, block int, n long, blob binary")
    back = rows.groupBy("dest").applyInPandas(_statistics(width, parts, length), "block int, part int, n long, blob binary")
    schema = "doc_id long, orphan boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text + "".join(f", {c} string" for c in carry)
    out = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_removal(width, parts, length, keep_text, list(carry)), schema)
    return out.withColumn("doc_id", F.when(~F.col("orphan"), F.col("doc_id"))).drop("orphan")
