import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm.toxicity import Index, _some, _vectors, features_of, logistic, numbered, score, sigmoid

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, docs_of, extra=()):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = f"plain words {i} about things" + (" utterly vilesome grubling" if toxic else " calm")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return docs_of(rows + list(extra)), spark.createDataFrame(labels, LABELS)


def test_learns_from_training_rows_only(spark, docs_of):
    docs, labels = corpus(spark, docs_of)
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == (i % 4 == 0) for i in got)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r.doc_id: r.score for r in score(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_odd_rows(spark, docs_of):
    extra = [(1000, None), (1001, ""), (None, "vilesome grubling"), (1002, "vilesome " * 50_000), (3, "plain"), (3, "plain")]
    docs, labels = corpus(spark, docs_of, extra)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 7), (5, 0, 1), (99999, 0, 1)], LABELS)
    got = score(docs.selectExpr("*", "1 AS label", "'x' AS fids", "'y' AS f"), labels.union(odd)).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1 and by[None].predicted == 1 and not by[None].held_out


def test_few_examples_have_features(spark, docs_of):
    docs = docs_of([(i, f"plain {i}" + (" vilesome" if i % 2 else " calm")) for i in range(24)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(24)], LABELS)
    assert all(r.predicted == r.doc_id % 2 for r in score(docs, labels).collect())


def test_votes_count_for_all_labels_of_their_kind(spark, docs_of):
    # half of those with the word are toxic, but most of the sampled ones
    rows = [(i, f"murky {i}" if i < 120 else f"calm {i}") for i in range(660)]
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(660)], LABELS)
    got = {r.doc_id: r.score for r in score(docs_of(rows), labels, per_class=60, k=200).collect()}
    assert all(0.3 < got[i] < 0.7 for i in range(120)) and all(got[i] < 0.1 for i in range(120, 660))


def test_no_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in score(docs_of([(1, "a")]), none).collect()] == [0.0]
    assert score(docs_of([]), none).count() == 0


def words_and_stems(text):
    """Features of a text in one script with spaces, by another way."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    return Counter(words + [w[:4] + "-" for w in words if len(w) > 4])


def fitted(x, y):
    """Offset and slope of a logistic curve by plain descent over a grid that closes in."""
    n1, n0 = sum(y), len(y) - sum(y)
    target = np.where(np.array(y) == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.array(x)
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a + b * x) - target * (a + b * x)))
    best, width = (0.0, 1.0), 4.0
    for _ in range(120):
        around = [(best[0] + i * width, best[1] + j * width) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        nearest = min(around, key=lambda p: loss(*p))
        if nearest == best:
            width /= 2
        best = nearest
    return best


def plain_scores(texts, labels, k=15, pull=0.1):
    """Every step again without an index, for labels of all classes under the bound: (doc_id, text) rows and {doc_id: label}."""
    learn = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5}
    counts = [dict(words_and_stems(t)) for _, t in texts]
    known = [(i, learn[i], c) for (i, _), c in zip(texts, counts) if i in learn]
    n_class = Counter(y for _, y, _ in known)
    in_class = [Counter(f for _, y, c in known if y == z for f in c) for z in (0, 1)]
    df = Counter(f for c in counts for f in c)
    weight = {}
    for f in in_class[0] | in_class[1]:
        rate = (in_class[0][f] + in_class[1][f]) / len(known)
        in0, in1 = ((in_class[z][f] + rate + 0.5) / (n_class[z] + 2) for z in (0, 1))
        weight[f] = (math.log((1 + len(texts)) / (1 + df[f])) + 1) * abs(math.log(in1) - math.log(in0))
    vector = lambda c: {f: (1 + math.log(n)) * weight[f] for f, n in c.items() if f in weight}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(i, y, c, vector(c)) for i, y, c in known]
    base = n_class[1] / len(known)

    def share(c):
        v = vector(c)
        near = []
        for i, y, other, u in vectors:
            dot = sum(x * u[f] for f, x in v.items() if f in u)
            if dot > 0 and {f: c[f] for f in c if f in weight} != other:
                near.append((-dot / size(u) / size(v), i, y))
        near = sorted(near)[:k]
        votes = -sum(s for s, _, _ in near)
        return (sum(-s * y for s, _, y in near) + pull * base) / (votes + pull) if near else None

    got = [(x, y) for _, y, c, _ in vectors if (x := share(c)) is not None]
    log_odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    a, b = fitted([log_odds(g[0]) for g in got], [g[1] for g in got])
    return [base if (x := share(c)) is None else 1 / (1 + math.exp(-a - b * log_odds(x))) for c in counts]


def test_scores_against_brute_force(spark, docs_of):
    rng = np.random.default_rng(6)
    calm, rude = ["able", "bake", "cold", "dance", "early"], ["fooled", "grubby", "hateful"]
    texts, labels = [], {}
    for i in range(160):
        words = [*rng.choice(calm, rng.integers(1, 9)), *rng.choice(rude, rng.integers(0, 3 if i % 3 else 5))]
        texts.append((i, " ".join(rng.permutation(words))))
        labels[i] = int(sum(w in rude for w in words) > rng.integers(0, 3))
    texts += [(200, texts[3][1]), (201, ""), (202, "unseen words only here")]
    made = spark.createDataFrame([(i, 1, y) for i, y in labels.items() if i % 7], LABELS)
    got = {r.doc_id: r.score for r in score(docs_of(texts), made).collect()}
    want = plain_scores(texts, {i: y for i, y in labels.items() if i % 7})
    assert [got[i] for i, _ in texts] == pytest.approx(want, abs=1e-5)


def test_a_rows_own_label_is_not_in_its_score(spark, docs_of):
    docs, labels = corpus(spark, docs_of)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN doc_id = 101 THEN 1 - toxic ELSE toxic END AS toxic")
    got = [{r.doc_id: r.score for r in score(docs, x).collect()}[101] for x in (labels, flipped)]
    assert zlib.crc32(b"101") % 5 and got[0] < 0.2 and got[1] < 0.2


def test_features():
    assert features_of(None) == features_of("?! _") == {}
    assert features_of("Toxic toxicity a_b") == {"toxic": 1, "toxi-": 2, "toxicity": 1, "a": 1, "b": 1}
    assert features_of("语言模型x好") == {"语言": 1, "言模": 1, "模型": 1, "x": 1, "好": 1}
    # every part of a long word or text is read
    assert features_of("abcdefgh") != features_of("abcdxyz") and features_of("好" * 9 + "坏")["好坏"] == 1


def test_features_of_many_texts_at_once():
    texts = ["Toxic toxicity a_b TOXIC-", None, "", "?!", "语言模型x好 语言 Ünïted ünï İstanbul ΣΑΣ", "x" * 70_000, "好好好 好", " lead\x1ftrail\x00x ", "toxi- toxi"]
    every = sorted(set().union(*map(features_of, texts)))
    for features in (every, every[::2], []):
        offsets, fids, tfs = numbered(texts, pa.array(features, pa.string()))
        for i, text in enumerate(texts):
            got = list(zip(fids[offsets[i] : offsets[i + 1]].tolist(), tfs[offsets[i] : offsets[i + 1]].tolist()))
            want = features_of(text)
            assert got == [(at, want[f]) for at, f in enumerate(features) if f in want]
    assert [len(x) for x in numbered([], pa.array(every))] == [1, 0, 0]


def test_long_texts_stand_alone():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "b" * (3 << 20), "c", "d"])], names=["text"])
    assert [p.num_rows for p in _some(batch, 0)] == [2, 1, 2]
    assert [p.num_rows for p in _some(batch.slice(1, 3), 0)] == [1, 1, 1]


def test_a_model_holds_postings_alone():
    """What every worker loads grows with the examples' features, not with features times blocks."""
    rng = np.random.default_rng(8)
    examples = [(i, i % 2, np.sort(rng.choice(60_000, 20, replace=False)), np.ones(20, int)) for i in range(1920)]
    assert len(pickle.dumps(Index(np.ones(60_000), examples, 15))) < 60_000 * 30 * 4


def test_scripts_without_spaces(spark, docs_of):
    calm, rude = "今天天气很好我们去公园散步", "滚开你这个讨厌的坏东西"
    texts = [(i, f"我在第{i}天写下这些话{calm if i % 2 else rude}然后就结束了") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(120)], LABELS)
    new = [(500, f"很长的一段话没有空格{'也没有别的' * 20}{rude}"), (501, f"很长的一段话没有空格{'也没有别的' * 20}{calm}")]
    got = {r.doc_id: r.predicted for r in score(docs_of(texts + new), labels).collect()}
    assert got[500] == 1 and got[501] == 0 and all(got[i] == int(i % 2 == 0) for i in range(120))


def test_steep_curves_stay_in_range():
    assert sigmoid(1e9) == 1.0 and 0 <= sigmoid(-1e9) < 1e-300 and sigmoid(0.0) == 0.5


def test_calibration():
    """Shares that overstate the odds come back to the rates behind them."""
    rng = np.random.default_rng(7)
    true = rng.uniform(-3, 3, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-true))).astype(float)
    a, b = logistic(3 * true + 1, y, np.ones(20000))
    assert a == pytest.approx(-1 / 3, abs=0.05) and b == pytest.approx(1 / 3, abs=0.03)
    assert logistic(np.ones(3), np.ones(3), np.ones(3)) == (0.0, 1.0)
    a, b = logistic(np.r_[-np.ones(50), np.ones(50)], np.r_[np.zeros(50), np.ones(50)], np.ones(100))
    assert 0 < b < 20


def examples_of(rng, n, features):
    out = []
    for i in range(n):
        f = sorted(rng.choice(features, rng.integers(1, 9), replace=False).tolist())
        out.append((i, i % 2, f, rng.integers(1, 6, len(f)).tolist()))
    return out


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    examples = examples_of(rng, 700, 50) + [(1000 + i, 1, [3, 4], [1, 2]) for i in range(100)]
    index = Index(rng.random(50) + 0.1, examples, 15)
    at = {e[0]: e for e in examples}
    for trial in range(100):
        f = sorted(rng.choice(50, 5, replace=False).tolist()) if trial else [3, 4]
        t = rng.integers(1, 6, 5).tolist() if trial else [1, 2]
        places, cos = index.nearest(f, t, *[(0.2, 512), (0.0, 512), (9.0, 5), (0.5, 3)][trial % 4])
        mine = dict(zip(f, index.unit(f, t)))
        want = []
        for i, _, g, s in examples:
            c = sum(mine.get(x, 0) * u for x, u in zip(g, index.unit(g, s)))
            if c > 0 and (g, s) != (f, t):
                want.append((-c, i))
        want = sorted(want)[:15]
        assert cos == pytest.approx([-c for c, _ in want], abs=1e-12)
        assert all((at[i][2], at[i][3]) != (f, t) for i in index.ids[places])


def test_few_postings_are_read():
    """A common feature of little weight has postings of all examples; they are not read."""
    rng = np.random.default_rng(5)
    examples = [(i, i % 2, [i // 64 * 3, i // 64 * 3 + 1, 99], rng.integers(1, 4, 3).tolist()) for i in range(1920)]
    index = Index(np.r_[np.ones(99), 0.05], examples, 15)
    places, _ = index.nearest([30, 31, 99], [1, 1, 5])
    assert len(places) == 15 and 0 < index.read <= 128


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "toxic", "score").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
    clean = got[got.toxic == 0]
    assert (clean.predicted == 1).mean() < 0.01
    assert got[got.predicted == 1].toxic.mean() > 0.9


def test_a_carried_text_goes_to_python_once(spark, docs_of):
    docs = docs_of([(1, "calm vilesome calm"), (2, None), (None, "vilesome")])
    carried, plain = (_vectors(docs, ["calm", "vilesome"], extra) for extra in (["doc_id", "text"], ["doc_id"]))
    sent = [str(d._jdf.queryExecution().analyzed().children().head().output().size()) for d in (carried, plain)]
    assert sent == ["2", "2"]
    key = lambda r: (r.doc_id or 0, r.fids, r.tfs)
    assert sorted(map(key, carried.collect())) == sorted(map(key, plain.collect())) == [(0, [1], [1]), (1, [0, 1], [2, 1]), (2, [], [])]
    assert {r.text for r in carried.collect()} == {"calm vilesome calm", None, "vilesome"}

