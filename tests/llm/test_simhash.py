import random
import re

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash
from cairn.llm.simhash import components, fingerprint, forest, links, near_duplicates


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """component of each row by comparing all pairs of fingerprints."""
    fps = [brute_fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{f:016x}", least.get(g)) for (d, _), f, g in zip(rows, fps, group)), key=str)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


def test_given_documents(small):
    check(small)


def test_odd_rows(docs_of):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    rows = [(5, None), (6, ""), (7, " \n"), (1, "One"), (2, "one"), (3, "ONE two"), (4, "É é"), (8, long), (9, long + " x"), (8, long), (None, "one"), (None, "alone here now"), (10, "a b c d"), (10, "quite another text")]
    check(docs_of(rows))
    check(docs_of(rows, extra=True))
    assert near_duplicates(docs_of([])).count() == 0


def test_long_texts_in_parts():
    text = " ".join(str(i * i) for i in range(500))
    assert fingerprint(text, part=7) == fingerprint(text) == brute_fp(text)


def near_set(n, seed=3):
    """Fingerprints with chains and a ball of near ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        out.append(x)
    centre = rng.getrandbits(64)
    out += [centre ^ sum(1 << b for b in rng.sample(range(40), 3)) for _ in range(n)]
    return sorted(set(out))


def classes(fps, pairs):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_connect_all_near_pairs(spark, hot):
    fps = near_set(120)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = [tuple(r) for r in links(df, hot=hot).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in got)
    assert classes(signed, got) == classes(signed, near)


def test_forest_is_small():
    fps = np.array(near_set(200), np.uint64)
    a, _ = forest(fps, 3)
    assert len(a) < len(fps)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
    assert simhash._second_bits(3)[0][0] == 3 and simhash._second_bits(40)[1][-1] == 31
