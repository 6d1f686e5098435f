import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import repeats
from cairn.llm.repeats import RunLengthIndex, _planes, _range_minima, _unplanes, anchors, remove_repeats, text_anchors


def gone_of(rows, length=50):
    """For each row, which of its bytes go."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            s = b[i : i + length]
            least[s] = min(d, least.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1) if d is not None else ():
            if least[b[i : i + length]] < d:
                gone[i : i + length] = True
        out.append(gone)
    return out


def kept_bytes(rows, length=50):
    return [bytes(x for x, g in zip((t or "").encode(), gone) if not g) for (_, t), gone in zip(rows, gone_of(rows, length))]


def brute(rows, length=50):
    out = []
    for (d, t), gone, kept in zip(rows, gone_of(rows, length), kept_bytes(rows, length)):
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        out.append((d, len(gone), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, remove_repeats(df, **options).collect()), key=str) == brute(rows, options.get("length", 50))


def test_given_documents(small):
    check(small)


def passages(seed, n=60, odd="é"):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde" + odd) for _ in range(rng.randint(1, 7)))
    pool = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(8)]
    pool += ["a" * 120, "ab" * 60, "x" * 49, "y" * 50, "z" * 51]
    return [(rng.randint(0, 40), " ".join(rng.choice(pool) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 25)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_ties_and_repeated_rows(docs_of, seed):
    check(docs_of(passages(seed)))


def test_other_length_and_blocks(docs_of):
    check(docs_of(passages(3)), length=30, block_bytes=500)


@pytest.mark.parametrize("hot", [1, 6])
def test_hot_anchors(docs_of, hot):
    """A passage in changing surroundings: its strings are dealt one by one, with the same result."""
    check(docs_of(passages(5)), hot=hot)
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice("mnopqrst") for _ in range(60))
    check(docs_of([(i, noise() + "The one passage that very many of the documents share, word for word." + noise()) for i in range(50)]), hot=hot)


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "q" * 50), (3, "q" * 50), (None, "q" * 60), (4, "q" * 49), (5, "q" * 51), (-1, "r" * 70), (6, "r" * 99 + "é" * 40), (7, "é" * 40)]
    check(docs_of(rows))
    check(docs_of(rows, extra=True))
    assert remove_repeats(docs_of([])).count() == 0


def test_kept_text_drops_halved_characters(docs_of):
    rows = [(1, "é" * 25), (2, "a" + "é" * 25 + "b"), (3, "é" * 24 + "x")]
    got = {r.doc_id: r.kept for r in remove_repeats(docs_of(rows), keep_text=True, carry=("lang", "source")).collect()}
    assert got == {1: "é" * 25, 2: "ab", 3: "é" * 24 + "x"}


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40), st.binary(min_size=50, max_size=90), st.binary(max_size=40))
def test_equal_strings_share_anchors(a, b, same, c):
    width = 27
    one, two = np.frombuffer(a + same, np.uint8), np.frombuffer(b + same + c, np.uint8)
    own = [anchors(x, width) for x in (one, two)]
    h, place = [], []
    for start in range(len(same) - 49):
        for (at, hash_, first, last), before in zip(own, (len(a), len(b))):
            i = int(np.flatnonzero((first <= before + start) & (before + start <= last))[0])
            h.append(int(hash_[i]))
            place.append(int(at[i]) - before)
    assert h[::2] == h[1::2] and place[::2] == place[1::2]


def test_long_texts_in_chunks(monkeypatch):
    b = np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8)
    strings = lambda found: {x: int(h) for _, h, a, z in zip(*found) for x in range(a, z + 1)}
    whole = strings(anchors(b, 27))
    monkeypatch.setattr(repeats, "CHUNK", 257)
    assert strings(text_anchors(b, 27)) == whole and len(whole) == len(b) - 49


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=76, max_size=76).map(lambda x: bytes(97 + c % 2 for c in x)) | st.sampled_from([b"a" * 76, b"ab" * 38, b"a" * 38 + b"b" * 38]), min_size=1, max_size=40))
def test_run_length_index_is_the_suffix_order(rows):
    index = RunLengthIndex(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 76), 27)
    for a in range(27):
        if a:
            index.extend()
        suffixes = [rows[i][26 - a :] for i in index.order]
        assert suffixes == sorted(suffixes)
        assert index.common[1:].tolist() == [len(os.path.commonprefix(x)) for x in zip(suffixes, suffixes[1:])]
    assert index.runs <= 26 * len(rows)


def test_copies_are_few_runs():
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.integers(97, 123, (20, 76), dtype=np.uint8), 100, axis=0)
    index = RunLengthIndex(rows, 27)
    for _ in range(26):
        index.extend()
    assert index.runs <= 26 * 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
def test_range_minima(values, data):
    values = np.array(values, np.int16)
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(values) - 1), st.integers(1, len(values))).filter(lambda x: x[0] < x[1]), min_size=1))
    start, stop = (np.array(x) for x in zip(*pairs))
    assert _range_minima(values, start, stop).tolist() == [values[i:j].min() for i, j in pairs]


def test_planes():
    h = np.sort(np.random.default_rng(2).integers(0, 2**64, 100, dtype=np.uint64))
    assert (_unplanes(_planes(h).tobytes(), 100) == h).all()
