import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import mixing, packing, repeats, simhash, toxicity
from cairn.llm.queries import ORACLES, QUERIES

from .test_repeats import kept_bytes
from .test_simhash import brute as plain_components
from .test_simhash import brute_fp
from .test_tokens import lib, plain_best_two_fit
from .test_toxicity import plain_scores

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_stage_acts_on_what_was_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, LARGER)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
        elif name == "simhash_dedup":
            groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(groups)
        elif name == "suffix_array_dedup":
            want = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
            got = {r.doc_id: r for r in out.collect()}
            assert set(got) == set(want) and any(n for _, n in want.values())
            assert all(len(got[i].text.encode()) == a - b or b for i, (a, b) in want.items())
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "mixing":
            assert out.count() == sum(r.copies for r in mixing.mix(docs).collect())
        else:
            assert out.groupBy().sum("length").first()[0] == packing.pack(docs).groupBy().sum("length").first()[0]
            break
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and all(kept.values())


def plain_kept(rows, labels):
    """The first three stages on (doc_id, text, source) rows in plain Python, and the words of each source that mixing meets."""
    scores = plain_scores([r[:2] for r in rows], labels)
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    groups, named = {}, {(d, f): c for d, f, c in plain_components([r[:2] for r in rows])}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        fp = f"{brute_fp(r[1]):016x}"
        root = named[(r[0], fp)]
        groups.setdefault(root if root is not None else ("none", fp), r)
    rows = list(groups.values())
    kept = kept_bytes([r[:2] for r in rows])
    rows = [(d, k.decode("utf-8", "ignore"), s) for (d, _, s), k in zip(rows, kept)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    return rows, size


def plain_run(rows, labels):
    """Pieces of all five stages; mixing is followed where targets are whole multiples of sizes, so that nothing is left to chance."""
    rows, size = plain_kept(rows, labels)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
        if not open_:
            break
    target |= {s: share[s] for s in open_}
    pieces = []
    for d, t, s in rows:
        times = target[s] / size[s]
        assert not t.split() or times == int(times), (size, target)
        for _ in range(int(times) if t.split() else 0):
            ids = [*lib(t), 0]
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            pieces += [(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return pieces, size


def test_run_against_brute_force(spark, docs_of, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = "a passage that stands in many of these documents, of well over fifty bytes"
    rows, labels = [], {}
    for i in range(90):
        rude = " vilesome grubling hateful vilesome" if i % 5 == 0 else ""
        text = some(rng.randint(30, 60)) + rude + (f" {passage} " if i % 4 == 1 else " ") + some(10)
        rows.append((i, text, ("s1", "s2", "s3")[i % 3]))
        if i < 70:
            labels[i] = int(i % 5 == 0)
    rows += [(200, rows[1][1], "s1"), (201, rows[2][1] + " more", "s2"), (None, some(50), "s1"), (None, rows[3][1].upper(), "s2"), (202, None, "s2"), (203, "", "s3"), (204, some(2600), "s2"), rows[7], rows[7]]
    filler = lambda n: (300, " ".join(f"filler{k}" for k in range(n)), "s3")
    _, size = plain_kept([*rows, filler(40)], labels)
    rows.append(filler(40 + size["s1"] + size["s2"] - size["s3"]))
    pieces, size = plain_run(rows, labels)
    assert size["s1"] + size["s2"] == size["s3"] and len(pieces) > 120

    folder = str(tmp_path)
    docs_of(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(pieces, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r.length)
    want = plain_best_two_fit(Counter(p[3] for p in pieces), 2048)
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, want))


def test_stages_take_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "x y"), (3, "word " * 3000, None), (4, "word " * 3000, None), (4, "word " * 3000, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == list(corpus_pipeline.COLUMNS)
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_each_row_has_its_own_toxic_verdict(spark, docs_of, tmp_path):
    toxic = "plain utterly vilesome grubling"
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, f"plain words {i}" + (" utterly vilesome grubling" if i % 4 == 0 else " calm")) for i in range(400)]
    odd = [(None, toxic), (None, "plain calm"), (None, None), (1, toxic), (1, toxic), (500, "plain calm"), (500, "plain calm")]
    got = corpus_pipeline.drop_toxic(spark, docs_of(rows + odd), str(tmp_path))
    want = [r for r in rows + odd if "vilesome" not in (r[1] or "")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, docs_of(want).collect())))


def test_one_row_of_each_group_stays(spark, docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(a.upper())).bit_count() <= 3
    rows = [(7, a), (7, a), (5, a.upper()), (5, a), (None, a), (None, b), (None, b), (9, c), (9, c), (9, c), (3, None), (None, ""), (2, " ")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs_of(rows), SF).collect()]
    assert sorted(r[0] for r in got if r[0] is not None) == [2, 5, 9] and len(got) == 4
    assert set(got) <= set(rows) and (None, b) in got and (9, c) in got and (2, " ") in got


@pytest.mark.parametrize("name", ORACLES)
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
