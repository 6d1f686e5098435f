"""Both Lloyd operators against full searches in plain Python."""

import hashlib
import math

import numpy as np
import pytest

from cairn.llm import centroids, codes
from cairn.llm.common import read

SF = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [math.floor(256 * float(x)) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(rows, entries, rounds):
    """Assignments of the last round and entries, by looking at every pair."""
    for n in range(rounds + 1):
        at = [min(range(len(entries)), key=lambda c: (apart(r, entries[c]), c)) for r in rows]
        if n < rounds:
            own = {c: [r for r, a in zip(rows, at) if a == c] for c in range(len(entries))}
            entries = [[sum(x) // len(own[c]) for x in zip(*own[c])] if own[c] else e for c, e in enumerate(entries)]
    return at, entries


def plain_codes(rows, parts=16, n=64, rounds=2):
    kept = sorted(((i, whole(v), label) for i, v, label in rows if good(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    books, found = [], []
    for p in range(parts):
        own = [v[p * w : (p + 1) * w] for _, v, _ in kept]
        at, book = lloyd(own, own[:n], rounds)
        books += [x for e in book for x in e]
        found.append([(a, apart(r, book[a])) for r, a in zip(own, at)])
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    out = [(i, "".join(f"{f[k][0]:02x}" for f in found), sum(f[k][1] for f in found), label) for k, (i, _, label) in enumerate(kept)]
    by = {}
    for _, _, e, label in out:
        by[label] = by.get(label, 0) + e
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=str)


def plain_clusters(rows, k=40, rounds=5, width=64):
    kept = [(i, whole(v)) for i, v, *_ in rows if good(v) and len(v) == width]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    if not kept:
        return []
    at, final = lloyd([v for _, v in kept], [v for _, v in start], rounds)
    d = [apart(v, final[a]) for (_, v), a in zip(kept, at)]
    per = {c: sum(x for x, a in zip(d, at) if a == c) for c in set(at)}
    return sorted(((i, a, x, per[a], sum(d), hashlib.sha256(",".join(map(str, final[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d)), key=str)


def coded(df, **options):
    return sorted(map(tuple, codes.compress(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def clustered(df, **options):
    return sorted(map(tuple, centroids.cluster(df, **options).collect()), key=str)


def made(n, seed=1, width=64, spread=0.05):
    """Vectors around a few places, with ties: components are multiples of 1/256."""
    r = np.random.default_rng(seed)
    places = r.normal(size=(8, width)) / 8
    return [(i, (np.rint((places[i % 8] + r.normal(size=width) * spread) * 256) / 256).tolist(), i % 3 or None) for i in range(n)]


def odd():
    rows = made(150) + made(30, seed=1)  # repeated rows
    bad = [(900, None, 1), (901, [None] * 64, 1), (902, [float("nan")] + [0.0] * 63, 1), (903, [float("inf")] * 64, 2), (904, [0.0] * 64, 1), (None, [0.25] * 64, None), (None, [0.25] * 64, None)]
    return rows + bad


def test_codes_of_given_vectors(spark):
    rows = [tuple(r) for r in read(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert coded(read(spark, SF, "embeddings")) == plain_codes(rows)


def test_clusters_of_given_vectors(spark):
    rows = [tuple(r) for r in read(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    assert clustered(read(spark, SF, "embeddings")) == plain_clusters(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd(), ROW).selectExpr("*", "'x' AS id", "1 AS v", "2 AS code", "3 AS cluster", "4 AS slot")
    assert coded(df) == plain_codes(odd())
    assert clustered(df) == plain_clusters(odd())


@pytest.mark.parametrize("n", [0, 1, 5, 39])
def test_few_rows(spark, n):
    df = spark.createDataFrame(made(n), ROW)
    assert coded(df) == plain_codes(made(n))
    assert clustered(df) == plain_clusters(made(n))


def test_other_widths(spark):
    rows = made(20) + [(500 + i, [0.5] * w, 1) for i, w in enumerate((0, 1, 63, 65, 128))]
    df = spark.createDataFrame(rows, ROW)
    assert coded(df) == plain_codes(made(20))
    assert clustered(df) == plain_clusters(made(20))


def test_huge_components_are_cut(spark):
    df = spark.createDataFrame([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)], ROW)
    assert [r[2] for r in coded(df)] == [0, 0, 0]
    assert [r[2] for r in clustered(df)] == [0, 0, 0]


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "MOST_LABELS", 1)
    assert coded(spark.createDataFrame(odd(), ROW)) == plain_codes(odd())


def test_bounds_save_distances_and_hold():
    v = np.array([whole(x) for _, x, _ in made(4000, spread=0.02)])
    parts = v.reshape(len(v), 16, 4)
    book = parts[:64].transpose(1, 0, 2)
    one = codes.Books(book)
    a, upper, lower = one.first(parts)
    moved = book + np.random.default_rng(3).integers(-1, 2, book.shape)
    a, upper, lower, computed = codes.Books(moved, book).again(parts, a, upper, lower)
    full, _, _ = codes.Books(moved).first(parts)
    assert (a == full).all() and computed < 0.5 * a.size * 64
    exact = np.sqrt((((parts[:, :, None] - moved[None]) ** 2).sum(-1)))
    assert (lower <= exact).all() and (upper >= np.take_along_axis(exact, a[..., None], 2)[..., 0]).all()

    start = v[:40]
    group = centroids.groups_of(start)
    a, upper, lower = centroids.Round(start, group).first(v)
    after = start + np.random.default_rng(4).integers(-1, 2, start.shape)
    a, upper, lower, computed = centroids.Round(after, group, start).again(v, a, upper, lower)
    full, _, _ = centroids.Round(after, group).first(v)
    assert (a == full).all() and computed < 0.5 * a.size * 40
    exact = np.sqrt(((v[:, None] - after[None]) ** 2).sum(-1))
    assert (upper >= exact[np.arange(len(v)), a]).all()
    exact[np.arange(len(v)), a] = np.inf
    assert all((lower[:, g] <= exact[:, group == g].min(axis=1)).all() for g in range(group.max() + 1))
