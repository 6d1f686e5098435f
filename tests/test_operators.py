import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.config import Settings
from cairn.operators import chunking, context, dense, fusion, lexical, metrics, relevance
from cairn.sources import corpus, registry
from cairn.streaming import incremental


def chunks_of(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [r.text for r in chunking.chunk_recursive(df, size=size, overlap=overlap).orderBy("chunk_no").collect()]


def test_recursive_chunks(spark):
    text = "para one is here.\n\npara two " + "word " * 60 + "\nnext line\n\n" + "x" * 130
    chunks = chunks_of(spark, text, 100, 20)
    assert all(0 < len(c) <= 100 for c in chunks) and chunks[0] == "para one is here."
    assert "".join("".join(chunks).split()).startswith("paraoneishere.paratwo")
    words = chunks_of(spark, " ".join(f"w{i}" for i in range(200)), 50, 20)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(words, words[1:]))
    assert chunks_of(spark, "short", 100, 20) == ["short"]
    assert chunks_of(spark, "a" * 25, 10, 3) == ["a" * 10, "a" * 10, "a" * 10, "a" * 4]


def test_header_sections(spark):
    text = "# A\nintro\n\nmore\n## B\n### C\nbody\n```\n# no header\n```\n## D\nend"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.text, (r.h1, r.h2, r.h3)) for r in chunking.sections(df).orderBy("section_no").collect()]
    assert got[0] == ("# A\nintro  \nmore", ("A", None, None))
    assert got[1][1] == ("A", "B", "C") and got[1][0].startswith("## B  \n### C\nbody") and "# no header" in got[1][0]
    assert got[2] == ("## D\nend", ("A", "D", None))


def test_section_lines(spark):
    df = spark.createDataFrame([(1, "x\n# A\n## B\ny\n# C\n#no\n### E")], "doc_id long, text string")
    got = [(r.section_no, r.h1, r.h2, r.h3) for r in chunking.section_lines(df).orderBy("line_no").collect()]
    assert got == [(0, None, None, None), (1, "A", None, None), (2, "A", "B", None), (2, "A", "B", None), (3, "C", None, None), (3, "C", None, None), (4, "C", None, "E")]


def test_chunk_fixed(spark):
    df = spark.createDataFrame([(1, "a" * 1000), (2, ""), (3, "b" * 500)], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_no, len(r.text)) for r in chunking.chunk_fixed(df).collect())
    assert got == [(1, 0, 500), (1, 1, 500), (1, 2, 100), (2, 0, 0), (3, 0, 500)]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "b_high_enrage_melee_magic.txt").write_text("two\nlines", encoding="utf-8")
    (tmp_path / "a.txt").write_text("é", encoding="utf-8")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("no")
    got = [tuple(r) for r in corpus.scan_corpus(spark, str(tmp_path)).collect()]
    assert got == [("a.txt", "é"), ("b_high_enrage_melee_magic.txt", "two\nlines")]
    names = spark.createDataFrame([("data/arch_glacor_high_enrage_melee_magic.txt",), ("something_else.txt",)], "n string")
    parts = [tuple(r) for r in names.select(corpus.style_of(F.col("n")), corpus.boss_of(F.col("n"))).collect()]
    assert parts == [("melee_magic", "arch_glacor"), ("something_else", "something_else")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        corpus.load_documents(spark, str(tmp_path / "empty"))


def test_json_files(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text('{"questions": [{"id": "q1", "question": "x", "expected_source": "a.txt", "tags": ["t"]}, {"id": "q2", "expected_source": ["a", "b"]}, {"id": "q3"}, {"id": "q4", "expected_source": []}]}')
    got = {r.id: r.expected_source for r in corpus.read_questions(spark, str(path)).collect()}
    assert got == {"q1": ["a.txt"], "q2": ["a", "b"], "q3": None, "q4": None}
    out = str(tmp_path / "answers")
    for n in (3, 1):
        corpus.write_json(spark.createDataFrame([(str(i), ["c"]) for i in range(n)], "id string, contexts array<string>"), out)
    assert corpus.read_answers(spark, out).count() == 1


def test_index_sinks_and_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 5), ("a", 9000), ("a", 3), (None, 1)], "source string, doc_id long")
    got = {r.doc_id: r.chunk_id for r in corpus.number_rows(rows, ["source", "doc_id"], "chunk_id").collect()}
    assert got == {1: 0, 3: 1, 9000: 2, 5: 3}
    many = [(["aa", "ab", "b", None][i % 4], [i * 3, -i, 10**18 if i == 2 else 2**40 + i, 7][i % 4]) for i in range(300)] + [("aa", None)]
    for order in (["source", "doc_id"], ["doc_id", "source"]):
        found = corpus.number_rows(spark.createDataFrame(many, "source string, doc_id long"), order, "n").collect()
        keyed = sorted((r.n, *((r[c] is not None, 0 if r[c] is None else r[c]) for c in order)) for r in found)
        assert [k[0] for k in keyed] == list(range(301)) and [k[1:] for k in keyed] == sorted(k[1:] for k in keyed)
    hot = spark.createDataFrame([(1,)] * 500 + [(10**18,), (None,)], "k long").withColumn("s", F.concat(F.lit("key "), F.col("k").cast("string")))
    by_text = {r.s: r.n for r in corpus.number_rows(hot.distinct(), ["s"], "n").collect()}
    assert by_text == {None: 0, "key 1": 1, f"key {10**18}": 2} and sorted(r.n for r in corpus.number_rows(hot, ["k"], "n").collect()) == list(range(502))
    assert corpus.number_rows(hot.filter("k = 0"), ["k"], "n").count() == 0
    plan = corpus.number_rows(hot, ["k"], "n")._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    for hybrid, want in ((False, 4), (False, 8), (True, 4)):
        corpus.write_index(rows, str(tmp_path / "index"), hybrid)
        assert spark.read.parquet(str(tmp_path / "index")).count() == want
    there = str(tmp_path / "index")
    assert corpus.index_exists(spark, there) and corpus.delete_index(spark, there) and not corpus.index_exists(spark, there) and not corpus.delete_index(spark, there)


def test_registry_and_runs(spark, tmp_path):
    one = registry.record(spark, "c", 3, ["b", "a"], Settings())
    two = registry.record(spark, "d", 4, ["a"], Settings(embedding_model="other"))
    rows = registry.upsert(registry.upsert(one, two), registry.record(spark, "c", 9, ["z"], Settings()))
    assert {r.collection: (r.chunk_count, r.guides) for r in rows.collect()} == {"c": (9, ["z"]), "d": (4, ["a"])}
    assert registry.get(rows, "nothing") == {}
    registry.check_embedding_model(rows, "c", Settings())
    registry.check_embedding_model(rows, "nothing", Settings())
    with pytest.raises(RuntimeError):
        registry.check_embedding_model(rows, "d", Settings())
    path = str(tmp_path / "runs")
    registry.log_retrieval(spark, path, rows, "c", {"mrr@10": 0.5}, {"why": 0.25}, 70)
    registry.log_retrieval(spark, path, rows, "x", {"mrr@10": 0.75}, {}, 70)
    registry.log_generation(spark, path, rows, "c", Settings(judge_model="j"), {"faithfulness": None, "relevancy": 1.0}, 82)
    registry.log_comparison(spark, path, "c", {"x": (0.25, 2.0, 0.04)})
    got = registry.leaderboard(spark.read.parquet(path)).collect()
    assert [r.run_name for r in got][:2] == ["x", "c"] and got[1].metrics == {"mrr_at_10": 0.5, "tag_why": 0.25}
    by = {r.run_name: r for r in got}
    assert by["generation_c"].params["judge_independent"] == "True" and by["x"].params["build_config"] == "unknown"
    assert by["comparison_vs_c"].metrics == {"x_mrr_diff": 0.25, "x_t": 2.0, "x_p": 0.04}


def brute_bm25(docs, query, k1=1.2, b=0.75):
    toks = {i: t.lower().split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for i, t in toks.items():
        s = 0.0
        for term in set(query.lower().split()):
            df = sum(term in x for x in toks.values())
            tf = t.count(term)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        if s:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark):
    docs = [(1, "red fox jumps"), (2, "red red hen"), (3, "blue fox and blue hen and more"), (4, ""), (5, "red fox jumps")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Red fox red"), (2, "absent"), (3, "hen")], "qid long, text string")
    got = lexical.search(queries, df, 3).orderBy("qid", "rank").collect()
    for qid, text in ((1, "red fox"), (3, "hen")):
        want = brute_bm25(docs, text)[:3]
        assert [r.doc_id for r in got if r.qid == qid] == [i for i, _ in want]
        assert [r.score for r in got if r.qid == qid] == pytest.approx([x for _, x in want], abs=1e-12)
    assert {r.qid for r in got} == {1, 3}


def test_bm25_ranks_by_full_scores_in_any_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(20)] + [(5, docs[5][1]), (5, docs[5][1]), (7, "w1 w1"), (200, None)]
    queries = [(q, " ".join(rng.choices(words, k=12))) for q in range(9)] + [(9, ""), (None, "w1")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "qid long, text string")
    toks = [(i, (t or "").lower().split()) for i, t in docs]
    n, avg = len(docs), sum(len(t) for _, t in toks) / len(docs)
    want = []
    for q, text in queries[:9]:
        scored = []
        for i, t in toks:
            parts = []
            for term in set(text.split()) & set(t):
                df_ = sum(term in x for _, x in toks)
                parts.append(math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * (t.count(term) * 2.2 / (t.count(term) + 1.2 * (0.25 + 0.75 * len(t) / avg))))
            if parts:
                scored.append((-sum(sorted(parts)), i))
        want += [(q, i) for _, i in sorted(scored, key=lambda x: (round(x[0], 12), x[1]))[:6]]
    run = lambda: [(r.qid, r.doc_id) for r in lexical.search(asked, df, 6).orderBy("qid", "rank").collect()]
    assert run() == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 25)
    assert run() == want
    shared = type("Held", (), {})()
    shared.value = lexical.QueryBlock([(1, "w1"), (2, "w1"), (2, "w2"), (3, "w9")])
    monkeypatch.setattr(lexical, "MOST_PAIRS", 3)
    postings = [[("w1", 0.5), ("w2", 2.0)], [("w2", 2.0), ("w1", 0.6875), ("other", 9.0)], [("w2", 2.0)]]
    lists = pa.array([[{"term": t, "w0": w} for t, w in x] for x in postings])
    batch = pa.RecordBatch.from_arrays([pa.array([8, 9, 10]), lists], names=["id", "postings"])
    got = [r for b in lexical._scores(shared, ["x"], 2)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["qid"], r["id"], round(r["score"], 6)) for r in got) == [(1, 8, 0.5), (1, 9, 0.6875), (2, 8, 2.5), (2, 9, 2.6875)]


def test_dense_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)] + [(300, None)], "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id < 5").selectExpr("vec_id AS qid", "embedding AS v")
    whole = sorted(map(tuple, dense.top_k(queries, vectors, 4).collect()))
    monkeypatch.setattr(dense, "BLOCK_BYTES", 30)
    monkeypatch.setattr(dense, "LEAST_BLOCKS", 3)
    assert sorted(map(tuple, dense.top_k(queries, vectors, 4).collect())) == whole
    assert all(r[2] == pytest.approx(1.0) for r in whole if r[3] == 1) and len(whole) == 20
    v = [(r.vec_id, r.embedding) for r in vectors.filter("vec_id < 200").collect()]
    norm = lambda x: math.sqrt(sum(a * a for a in x))
    for q, own in v[:5]:
        want = sorted((-sum(a * b for a, b in zip(own, x)) / (norm(own) * norm(x)), i) for i, x in v)[:4]
        assert [(r[1], r[3]) for r in whole if r[0] == q] == [(i, n + 1) for n, (_, i) in enumerate(want)] or [r[2] for r in whole if r[0] == q] == pytest.approx([-s for s, _ in want])
    assert dense.top_k(queries.limit(0), vectors).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 9, 1), (1, 7, 3)], "qid long, doc_id long, rank long")
    got = fusion.rrf([a, b], 10).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(7, 1 / 63 + 1 / 61), (9, 1 / 61), (8, 1 / 62)]


def test_plan_choice(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    vq = spark.createDataFrame([(1, [1.0, 0.1])], "qid long, v array<float>")
    tq = spark.createDataFrame([(1, "b")], "qid long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    top = lambda **o: fusion.hybrid(tq, vq, docs, vectors, 1, **o).first()
    assert top().doc_id == 2 and top().score == pytest.approx(1 / 61 + 1 / 62)
    assert top(is_hybrid=False).doc_id == 1
    assert fusion.hybrid(None, vq, docs, vectors, 1).first().doc_id == 1


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, "", "b"), (1, 1, "melee_magic", "a [enrageband500]"), (1, 3, "other", "c")], "qid long, rank long, style string, text string")
    assert context.format_context(hits).first().context == "[From the Hybrid Melee/Magic guide]\na\n\n[From the guide guide]\nb\n\n[From the other guide]\nc"
    p = spark.range(1).select(context.prompt(F.lit("C"), F.lit("Q")).alias("p")).first().p
    assert "C" in p and p.index("C") < p.rindex("Q")


def test_relevance(spark):
    q = spark.createDataFrame([(1, None, "Part A", "fox"), (2, ["s2"], "part", "fox"), (3, [], "", "fox"), (4, ["s9"], "Part", "Fox")], "qid long, expected_source array<string>, expected_section string, expected_phrase string")
    chunks = spark.createDataFrame([(10, "s1", "__Part A__", "red fox"), (11, "s2", "Part B", "a fox"), (12, "s9", None, "Fox")], "doc_id long, source string, section string, text string")
    labels = relevance.qrels(q, chunks)
    assert sorted((r.qid, r.doc_id) for r in labels.collect()) == [(1, 10), (2, 11)]
    assert {r.qid: r.n_relevant for r in relevance.qrels_size(labels).collect()} == {1: 1, 2: 1}
    assert sorted(r.qid for r in relevance.unlabelled(q, labels).collect()) == [3, 4]


QUESTION = "qid long, expected_source array<string>, expected_section string, expected_phrase string"


def test_any_number_of_questions_is_labelled(spark):
    q = spark.createDataFrame([(i, None, "part", f"w{i}.") for i in range(10_050)], QUESTION)
    chunks = spark.createDataFrame([(1, "s", "Part", "w3. w10049."), (2, "s", "Part", "w10049.")], "doc_id long, source string, section string, text string")
    assert sorted((r.qid, r.doc_id) for r in relevance.qrels(q, chunks).collect()) == [(3, 1), (10049, 1), (10049, 2)]


def test_blocks_of_questions_label_as_one(spark, monkeypatch):
    rows = [(i if i % 9 else None, [None, ["s1"], [], ["s2", None]][i % 4], ["Part", "", None, "A"][i % 7 % 4], ["fox", "red", "", None, "x"][i % 5]) for i in range(200)]
    q = spark.createDataFrame(rows + rows[:3], QUESTION)
    chunks = spark.createDataFrame([(10, "s1", "__Part A__", "red fox"), (11, "s2", "Part B", "a fox"), (None, None, "A", "Fox x")], "doc_id long, source string, section string, text string")
    whole = lambda: sorted(map(str, relevance.qrels(q, chunks).collect()))
    one = whole()
    monkeypatch.setattr(relevance, "QUESTION_BYTES", 500)
    assert whole() == one and one
    assert relevance.qrels(q, chunks)._jdf.queryExecution().optimizedPlan().toString().count("Join") > 3


def test_questions_meet_chunks_by_a_word(spark):
    rng = random.Random(3)
    text = lambda n: rng.choice(["", " "]) + "".join(rng.choice(["ab", "c", "dd"]) + rng.choice([" ", " ", "\n", "  ", ""]) for _ in range(n))
    chunks = [(i, "s", "Part", text(30)) for i in range(40)]
    phrases = [c[3][a : a + n] for c in chunks[:20] for a, n in ((0, 9), (3, 14), (7, 2), (10, 30))]
    q = spark.createDataFrame([(i, None, "part", p) for i, p in enumerate(phrases)], QUESTION)
    got = relevance.qrels(q, spark.createDataFrame(chunks, "doc_id long, source string, section string, text string"))
    want = sorted((i, c[0]) for i, p in enumerate(phrases) for c in chunks if p and p in c[3])
    assert sorted((r.qid, r.doc_id) for r in got.collect()) == want


@pytest.mark.parametrize("n,want", [(10, (8, 2)), (1, (0, 1)), (0, (30, 10)), (None, (30, 10))])
def test_stratified_limit(spark, n, want):
    q = spark.range(40).selectExpr("id AS qid", "id % 4 <> 0 AS answerable")
    got = relevance.stratified_limit(q, n).groupBy("answerable").count().collect()
    counts = {r.answerable: r["count"] for r in got}
    assert (counts.get(True, 0), counts.get(False, 0)) == want


def test_metrics(spark):
    run = spark.createDataFrame([(1, 5, 9.0, 1), (1, 6, 8.0, 2), (2, 5, 3.0, 1), (3, 7, 1.0, 1)], "qid long, doc_id long, score double, rank long")
    labels = spark.createDataFrame([(1, 6), (1, 5), (2, 99), (4, 1)], "qid long, doc_id long")
    ranks = metrics.reciprocal_rank(run, labels)
    assert {r.qid: (r.first_rank, r.rr) for r in ranks.collect()} == {1: (1, 1.0), 2: (None, 0.0), 4: (None, 0.0)}
    assert metrics.hit_rates(ranks).first()["hit_rate@1"] == pytest.approx(1 / 3)
    a = spark.createDataFrame([(1, 3, 2.0), (2, None, 0.0), (3, None, 1.0)], "qid long, first_rank long, top_score double")
    b = spark.createDataFrame([(1, 1, 2.0), (2, 10, 0.0), (3, None, 1.0)], "qid long, first_rank long, top_score double")
    compared = metrics.compare_ranks(a, b)
    assert {r.qid: r.change for r in compared.collect()} == {1: "better", 2: "better", 3: "tie"}
    assert tuple(metrics.rank_changes(compared).first()) == (2, 2, 0)


def test_tags_and_paired_t(spark):
    rr = [("x", i, float(i % 2)) for i in range(8)] + [("y", i, 1.0) for i in range(6)] + [("y", 99, 1.0)]
    ranks = spark.createDataFrame(rr, "collection string, qid long, rr double")
    tags = spark.createDataFrame([(i, "t") for i in range(8)] + [(0, "rare"), (99, "t")], "qid long, tag string")
    assert [tuple(r) for r in metrics.mrr_by_tag(tags, ranks, ["x", "y"]).collect()] == [("t", 8, 0.5, 0.75)]
    r = metrics.paired_t(ranks, "x").first()
    d = [1.0 - i % 2 for i in range(6)]
    sd = math.sqrt(sum((x - 0.5) ** 2 for x in d) / 5)
    assert (r.collection, r.n, r.mean_diff, r.t) == ("y", 6, 0.5, pytest.approx(0.5 / (sd / math.sqrt(6))))
    assert (r.p, r.verdict) == (pytest.approx(metrics.p_value(r.t, 5)), metrics.verdict(r.p))
    same = metrics.paired_t(ranks.filter("collection = 'x'").unionAll(ranks.filter("collection = 'x'").selectExpr("'z'", "qid", "rr")), "x").first()
    assert (same.mean_diff, same.t, same.p, same.verdict) == (0.0, None, None, None)


@pytest.mark.parametrize("t,freedom,p", [(3.25, 69, 0.0018), (2.08, 37, 0.0445), (1.92, 37, 0.0626), (1.59, 37, 0.120), (0.0, 5, 1.0)])
def test_p_value(t, freedom, p):
    assert metrics.p_value(t, freedom) == pytest.approx(p, abs=6e-4)
    assert metrics.verdict(0.04) == "significant" and metrics.verdict(0.05) == "not significant"


def test_streamed_postings(spark, tmp_path):
    source = str(tmp_path / "docs")
    out, check = str(tmp_path / "postings"), str(tmp_path / "check")
    for i in range(2):
        spark.createDataFrame([(10 * i + j, f"a w{j} é") for j in range(3)], "doc_id long, text string").write.mode("append").parquet(source)
        incremental.append_postings(spark.readStream.schema("doc_id long, text string").parquet(source), out, check).awaitTermination()
    docs = spark.read.parquet(source)
    want = lexical.term_idf(*lexical.index(docs))
    assert sorted(map(tuple, incremental.current_idf(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_dense_products_are_held_in_steps(monkeypatch):
    rng = np.random.default_rng(4)
    q, v, ids = rng.normal(size=(90, 8)), rng.normal(size=(700, 8)), np.arange(700)[::-1].copy()
    rows = lambda: [tuple(map(tuple, r)) for r in dense._best(q, ids, v, 5, True)]
    whole = rows()
    monkeypatch.setattr(dense, "MOST_PAIRS", 2000)
    held = []
    part = np.partition
    monkeypatch.setattr(dense.np, "partition", lambda x, *a, **o: held.append(x.size) or part(x, *a, **o))
    assert rows() == whole and len(whole) == 90 and max(held) <= 2000


def test_grams_are_found_without_a_row_for_each(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["", "a", "\U0001f600b\U0001f600", *("".join(rng.choices("ab cé\U0001f600", k=rng.randint(0, 60))) for _ in range(60))]
    grams = {"a", "é", "ab", " c", "abab", "b\U0001f600ca", "aaaaaaaa", texts[5][:8]} - {""}
    finder = relevance.Finder(grams)
    assert sorted(zip(*(x.tolist() for x in finder.find(texts)))) == sorted((i, n) for i, t in enumerate(texts) for n, g in enumerate(finder.grams) if g in t)
    chunks = spark.createDataFrame([(i, "s", "Part", t) for i, t in enumerate(texts)], "doc_id long, source string, section string, text string")
    phrases = ["a", "é\U0001f600", "ab ", "bbb", "never there", texts[7][:11]]
    q = spark.createDataFrame([(i, None, "part", p) for i, p in enumerate(phrases)], QUESTION)
    want = sorted((i, d) for i, p in enumerate(phrases) for d, t in enumerate(texts) if p in t)
    monkeypatch.setattr(relevance, "STEP_CHARS", 40)
    found = relevance.qrels(q, chunks)
    assert sorted((r.qid, r.doc_id) for r in found.collect()) == want
    # texts were multiplied by their grams before
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_search_moves_no_document(spark):
    docs = spark.createDataFrame([(i % 50, f"w{i % 7} w{i % 3} é") for i in range(100)] + [(None, "w1"), (60, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "é absent")], "qid long, text string")
    found = lexical.search_variants(queries, docs, {"a": 0.75, "b": 0.0}, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # documents were exchanged, gathered and joined with the terms before
    assert "Join" not in plan and "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert [r["rank"] for r in found.orderBy("collection", "qid", "rank").collect()] == [1, 2, 3] * 4


def test_terms_are_turned_over_a_few_documents_at_a_time(monkeypatch):
    shared = type("Held", (), {"value": lexical.QueryBlock([(1, "a"), (1, "b"), (2, "b")])})()
    texts = [["b", "a", "b", "c"], [], ["c"], ["a"]] * 5
    batch = pa.RecordBatch.from_arrays([pa.array([*range(19), None]), pa.array(texts, pa.list_(pa.string()))], names=["id", "t"])
    monkeypatch.setattr(lexical, "STEP_ROWS", 3)
    made = list(lexical._counts(shared)(iter([batch.slice(1)])))
    assert max(b.num_rows for b in made) == 3
    got = [(r["len"], dict(zip(r["terms"], r["tfs"]))) for b in made for r in b.to_pylist()]
    assert got == [(len(t), {n: t.count(x) for n, x in enumerate("ab") if x in t}) for t in texts[1:]]
    weighed = list(lexical._weighted(iter(made), np.array([1.0, 2.0]), 2.0, 1.2, {"x": 0.0}))
    assert [p["term"] for b in weighed for r in b.to_pylist() for p in r["postings"]] == [n for _, c in got for n in c] and max(b.num_rows for b in weighed) == 3


def test_document_frequencies_without_postings(spark):
    once = [(i, f"w{i % 7} w{i % 3} é w{i}") for i in range(40)] + [(None, "w1"), (60, None), (61, "")]
    for docs in (once, once + [(3, "w1 w2 w1 w9"), (3, "w3 w3 w3"), (None, "w1"), (None, "w2"), (60, ""), (3, "w1 w8 w1 w8")]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = lexical.corpus_idf(df)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.term_idf(*lexical.index(df)).collect()))
    # every posting was exchanged before
    plan = lexical.corpus_idf(spark.createDataFrame(once, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(term" in plan
