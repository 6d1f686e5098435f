"""Token counts and ids of a public byte-level BPE, encoded in Arrow batches.

``Encoder`` gives exactly what the ``tokenizers`` library gives for the .json file with
add_special_tokens=False, through the rank file of the same vocabulary: both libraries
use the same pattern, and a test compares their classes of letters, numbers and white
space on every code point. Special strings are cut out first, as the library does, and
give their own ids. Without a rank file, ``tokenizers`` itself encodes.

A batch holds a bounded number of bytes, whatever its rows. Texts over ``SPLIT``
characters are cut where no token can stand across the cut: before white space that
follows another character, or between two characters that are not white space where no
entry of the vocabulary spans the two sides. So texts without spaces, in any script, are
cut too; only a run whose every place is inside some entry (one letter repeated for
megabytes) is encoded whole. A run of over ``SPLIT`` white-space characters is one token of
the pattern, but for its last character if another follows; it is merged without the
pattern, which would need a stack as deep as the run, and as one count for equal neighbours
if it repeats one byte.

Defined cases: a null text counts as empty (0 tokens); every row, repeated or not, gives
one row; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import give_back

BATCH_BYTES = 1 << 20
SPLIT = 1 << 16
NEAR = 1 << 12

#: What the pattern takes for white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LONG_WHITE = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{SPLIT},}}+")
_BEFORE_SPACE = re.compile("(?<=[^\\s᠎])(?=[ \t\n\r])")
_SPACE = re.compile("[\\s᠎]")


def default_vocabulary() -> tuple[str, str]:
    """The .json file and the rank file of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, json_path: str, rank_path: str | None):
        with open(json_path, "rb") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        # other flags change what around a special string belongs to it
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.mark = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.fast = self.exact = None
        if rank_path and plain:
            import public_tokenizers
            import tiktoken

            with open(rank_path, "rb") as f:
                self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.longest = max(map(len, self.ranks))
            self.inside = np.zeros((256, 256), bool)  # pairs of bytes that stand in some entry
            joined = np.frombuffer(b"".join(self.ranks), np.uint8)
            last = np.cumsum([len(t) for t in self.ranks])[:-1] - 1
            pairs = np.ones(len(joined) - 1, bool)
            pairs[last] = False
            self.inside[joined[:-1][pairs], joined[1:][pairs]] = True
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(json_path)
            self.exact.no_padding()
            self.exact.no_truncation()

    def spanned(self, text: str, at: int) -> bool:
        """True if some entry of the vocabulary stands across the place between two characters."""
        left, right = (x.encode() for x in (text[max(0, at - self.longest) : at], text[at : at + self.longest]))
        if not self.inside[left[-1], right[0]]:
            return False
        for total in range(2, self.longest + 1):
            for n in range(max(1, total - len(right)), min(total, len(left) + 1)):
                if left[len(left) - n :] + right[: total - n] in self.ranks:
                    return True
        return False

    def cut(self, text: str, at: int) -> int | None:
        """The first safe place from ``at`` on that is found."""
        if found := _BEFORE_SPACE.search(text, at, min(len(text), at + NEAR)):
            return found.start()
        for i in range(at, len(text)):
            around = text[i - 2 : i + 1]
            # an apostrophe may begin a contraction on one side of the cut only
            if not _SPACE.search(around[1:]) and "'" not in around and not self.spanned(text, i):
                return i
            if _BEFORE_SPACE.match(text, i):
                return i
        return None

    def parts(self, text: str) -> Iterator[str]:
        """Pieces of about SPLIT characters without special strings whose ids, one after the other, are those of the text; special strings on their own."""
        if self.fast is None:
            yield text
            return
        for piece in self.stretches(text):
            if self.white(piece):
                yield piece
                continue
            at = 0
            while len(piece) - at > SPLIT and piece not in self.special and (cut := self.cut(piece, at + SPLIT)):
                yield piece[at:cut]
                at = cut
            if at < len(piece):
                yield piece[at:] if at else piece

    def stretches(self, text: str) -> Iterator[str]:
        """Special strings, long runs of white space, and what is between."""
        for piece in self.mark.split(text) if self.mark and self.mark.search(text) else (text,):
            at = 0
            for run in _LONG_WHITE.finditer(piece):
                start, end = run.span()
                end -= end < len(piece)  # the last one belongs to what follows
                if start > at:
                    yield piece[at:start]
                yield piece[start:end]
                at = end
            yield piece[at:] if at else piece

    def white(self, part: str) -> bool:
        """True for a part that is one long run of white space."""
        return len(part) >= SPLIT - 1 and part[0] in WHITE and part[-1] in WHITE and not part.strip(WHITE)

    def white_ids(self, run: str) -> np.ndarray:
        """The ids of a run that the pattern takes whole."""
        if run[0] < "\x80" and run.count(run[0]) == len(run):
            return self.repeated(run[0].encode(), len(run))
        return np.array(self.fast._encode_single_piece(run), np.uint32)

    def repeated(self, byte: bytes, n: int) -> np.ndarray:
        """The ids of one byte n times: merges by falling priority, over (entry, how often) instead of single entries."""
        runs = [(byte, n)]
        rank = lambda a, b: self.ranks.get(a + b, len(self.ranks) + 256)
        while True:
            inside = [rank(x, x) for x, m in runs if m > 1]
            between = [rank(x, y) for (x, _), (y, _) in zip(runs, runs[1:])]
            best = min(inside + between, default=None)
            if best is None or best >= len(self.ranks) + 256:
                return np.concatenate([np.full(m, self.ranks[x], np.uint32) for x, m in runs])
            out: list[tuple[bytes, int]] = []

            def put(x: bytes, m: int) -> None:
                if m and out and out[-1][0] == x:
                    out[-1] = (x, out[-1][1] + m)
                elif m:
                    out.append((x, m))

            todo = runs[::-1]
            while todo:
                x, m = todo.pop()
                if m > 1 and rank(x, x) == best:
                    put(x + x, m // 2)
                    m %= 2
                if m and todo and rank(x, todo[-1][0]) == best:
                    y, k = todo.pop()
                    put(x, m - 1)
                    put(x + y, 1)
                    if k > 1:
                        todo.append((y, k - 1))
                else:
                    put(x, m)
            runs = out

    def ids(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if self.fast is None:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        of = lambda p: np.array([self.special[p]] if p in self.special else self.fast.encode_ordinary(p), np.uint32)
        own = [self.white_ids(p) if self.white(p) else of(p) for p in self.parts(text)]
        return own[0] if len(own) == 1 else np.concatenate([np.zeros(0, np.uint32), *own])

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; their parts are encoded in batches of bounded size."""
        out = np.zeros(len(texts), np.int64)
        batch: list[str] = []
        owner: list[int] = []

        def encode() -> None:
            if self.fast is None:
                n = [len(e) for e in self.exact.encode_batch_fast(batch, add_special_tokens=False)]
            else:
                n = [len(e) for e in self.fast.encode_ordinary_batch(batch, num_threads=1)]
            np.add.at(out, owner, n)
            batch.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                if self.fast is not None and part in self.special:
                    out[i] += 1
                    continue
                if self.fast is not None and self.white(part):
                    out[i] += len(self.white_ids(part))
                    continue
                if batch and size + len(part) > 2 * SPLIT:
                    encode()
                    size = 0
                batch.append(part)
                owner.append(i)
                size += len(part)
        if batch:
            encode()
        return out


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, rank_path: str | None) -> Encoder:
    return Encoder(json_path, rank_path)


def balanced(sizes: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[slice]:
    """Consecutive slices of ``limit`` bytes at most, or of one row."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(start, stop)
        start = stop


def byte_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[str]]]:
    """doc_ids, numbers of bytes and texts of bounded slices; only a slice's texts are Python strings at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for s in balanced(sizes):
            own = batch.slice(s.start, s.stop - s.start)
            yield own.column(0), sizes[s], [x or "" for x in own.column(1).to_pylist()]
    give_back()


def count_tokens(docs: DataFrame, vocabulary: tuple[str, str | None] | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a map over the scan, no shuffle."""
    json_path, rank_path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path, rank_path)
        for ids, sizes, texts in byte_batches(batches):
            n = enc.lengths(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
