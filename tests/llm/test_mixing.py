import random
import re

import pytest

from cairn.llm.common import with_copies
from cairn.llm.mixing import mix, mix_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(df):
    got = mix(df).collect()
    rows = df.select("doc_id", "text", "source").collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((r.doc_id, r.source, size(r.text)) for r in rows), key=str)
    sizes, largest = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        largest[r.source] = max(largest.get(r.source, 0), size(r.text))
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(tuple, mix(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    return got


def test_given_documents(small):
    check(small)


def test_hot_source_and_odd_rows(docs_of):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice("aaaaaaabc")) for i in range(900)]
    rows += [(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, "p q\x85r", "z"), (7, "big " * 20_000, "é")]
    check(docs_of(rows))
    check(docs_of(rows, extra=True))


def test_a_third_of_all_rows_alike(docs_of):
    rows = [(1, "w x y", "a")] * 400 + [(None, "p q", "b")] * 301 + [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(10, 500)]
    got = check(docs_of(rows))
    for key in ((1, "a"), (None, "b")):
        taken = [r.copies for r in got if (r.doc_id, r.source) == key]
        f = next(r.target / r.source_size for r in got if r.source == key[1])
        assert abs(sum(taken) - f * len(taken)) < 1 + 1e-9  # all but one settle among themselves


@pytest.mark.parametrize("copies", [0, 1, 7, 8, 9])
def test_copies_in_steps(spark, copies):
    df = spark.createDataFrame([(1, copies), (2, 3)], "doc_id long, n long")
    got = [r.doc_id for r in with_copies(df, "n", step=4).collect()]
    assert sorted(got) == [1] * copies + [2] * 3


@pytest.mark.parametrize("rows", [[], [(1, "")], [(1, None, None)], [(1, "a b c")]], ids=["none", "blank", "null", "one"])
def test_few_rows(docs_of, rows):
    check(docs_of(rows))


def test_expected_copies_follow_the_target(docs_of):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(300)]
    total = {}
    for seed in range(3):
        for r in mix(docs_of(rows), seed=seed, fan_in=8).collect():
            total.setdefault(r.source, []).append(r.copies - r.target / r.source_size)
    assert all(abs(sum(x) / len(x)) < 0.1 for x in total.values())


def test_rows_are_repeated(docs_of):
    df = docs_of([(i, f"t{i} x", "abc"[i % 3]) for i in range(60)] + [(5, "t5 y", "c"), (5, "t5 x", "c")])
    out = mix_rows(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in mix(df).collect())
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
