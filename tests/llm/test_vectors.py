import math

import numpy as np
import pytest

from cairn.llm.ann import block_neighbours, neighbours, quantise, tile_product
from cairn.llm.topk import ImpactIndex, block_top, top_k, whole

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(spark, vectors, extra=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], SCHEMA)
    return df.selectExpr("*", "'x' AS id", "'x' AS v", "1 AS qb", "1 AS score") if extra else df


def brute(vectors, score, ok, k=5):
    """Rows are candidates and queries each on its own."""
    good = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and ok(v)]
    out = []
    for at, (q, own) in enumerate(good):
        if q % 50 == 0:
            near = sorted((-score(own, v), i) for other, (i, v) in enumerate(good) if other != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def product(a, b):
    return int(sum(int(math.floor(256 * float(np.float32(x)))) * int(math.floor(256 * float(np.float32(y)))) for x, y in zip(a, b)))


def cosine(a, b):
    a, b = ([float(np.float32(x)) for x in v] for v in (a, b))
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / (math.sqrt(dot(b, b)) * math.sqrt(dot(a, a)))


RNG = np.random.default_rng(5)
RANDOM = [(i, [float(x) for x in RNG.normal(size=8)]) for i in range(120)]
COPIES = RANDOM + [(i, RANDOM[3][1]) for i in range(200, 260)] + [(i, [1.0] * 8) for i in range(300, 320)]
ODD = RANDOM[:60] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, [0.0] * 8), (50, RANDOM[50][1]), (50, RANDOM[50][1]), (50, RANDOM[9][1]), (7, RANDOM[7][1]), (7, RANDOM[8][1])]


@pytest.mark.parametrize("vectors", [RANDOM, COPIES, ODD, RANDOM[:1], RANDOM[:3], []], ids=["random", "copies", "odd", "one", "three", "none"])
@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(spark, vectors, extra):
    got = sorted(map(tuple, top_k(rows(spark, vectors, extra)).collect()))
    assert got == brute(vectors, product, lambda v: True)
    near = sorted(map(tuple, neighbours(rows(spark, vectors, extra)).collect()))
    want = brute(vectors, cosine, any)
    assert [x[:3] for x in near] == [x[:3] for x in want]
    assert [x[3] for x in near] == pytest.approx([x[3] for x in want], abs=1e-12)


def plain_top(ids, v, q, k):
    s = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in v]
    return [(int(ids[i]), s[i]) for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]]


@pytest.mark.parametrize("spread", [0.01, 0.1, 1.0, 50.0])
def test_impact_ordered_search_is_exact(spread):
    rng = np.random.default_rng(1)
    v = whole(rng.normal(size=(2000, 32)) * spread)
    ids = rng.permutation(2000)
    index = ImpactIndex(ids, v)
    assert index.search(v[::10], 5) == [plain_top(ids, v, q, 5) for q in v[::10]]
    assert ImpactIndex(ids, v, levels=3).search(v[::50], 5) == [plain_top(ids, v, q, 5) for q in v[::50]]


def test_most_segments_are_never_read_where_few_vectors_stand_out():
    rng = np.random.default_rng(2)
    centres = rng.choice([-1.0, 1.0], (40, 64)) * (rng.random((40, 64)) < 0.15)  # a few large components each
    v = whole(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 64)) / 20)
    ids = np.arange(2000)
    index = ImpactIndex(ids, v)
    assert index.search(v[::50], 5) == [plain_top(ids, v, q, 5) for q in v[::50]]
    assert index.read < 0.6 * index.total


def test_whole_numbers_of_any_size():
    v = np.array([[2e5, 3e5], [1e30, -1e30], [3e38, 1.0], [-7.001, 0.0]])
    assert whole(v).tolist() == [[int(math.floor(256 * x)) for x in row] for row in v.tolist()]
    big, ids = whole(v), np.array([9, 8, 7, 6])
    assert ImpactIndex(ids, big).search(big, 3) == [plain_top(ids, big, q, 3) for q in big]
    mid = np.array([[2e5, 3e5], [1.5e6, -1e6], [1.0, 1.0]])
    assert ImpactIndex(ids[:3], whole(mid)).search(whole(mid), 3) == [plain_top(ids[:3], whole(mid), q, 3) for q in whole(mid)]
    with pytest.raises(OverflowError):
        block_top(v, ids, v, 3)
    with pytest.raises(OverflowError):
        whole(np.array([[1e308]]))


def test_extreme_lengths_of_vectors():
    v = np.array([[1e30, 0], [1e-30, 1e-30], [0, 1e30], [3e-31, 0]])
    _, got = block_neighbours(v[:1], np.arange(4), v, 5)
    assert [x[1] for x in got] == [0, 3, 1, 2]


@pytest.mark.parametrize("width", [1, 64, 1500, 8192])
def test_tiles_are_exact_and_bounds_hold_at_any_width(width):
    rng = np.random.default_rng(width)
    v = np.abs(rng.normal(size=(30, width))) + 0.1
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    codes, scale, kept, cut = quantise(unit)
    wide = codes.astype(np.int64)
    near = tile_product(codes, codes)
    assert (near == wide @ wide.T).all()
    error = cut[:, None] * (kept + cut) + kept[:, None] * cut + 1e-15 * (width + 64)
    assert (np.abs(near * scale[:, None] * scale - unit @ unit.T) <= error).all()
    _, got = block_neighbours(v, np.arange(30), v, 4, tile=7)
    cos = unit @ unit.T
    for at in range(30):
        want = np.lexsort((np.arange(30), -cos[at]))[:4]
        assert np.allclose(cos[at, [x[1] for x in got if x[0] == at]], cos[at, want], atol=1e-12)
