"""The stored index: equal to a full search in every state, and what it skips."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import english, lexical, stored
from cairn.sources import store, work
from cairn.sources.store import Conflict, counted

DOC = "doc_id long, text string"


@pytest.fixture
def index(spark, tmp_path):
    return stored.open_store(spark, str(tmp_path / "index"), stripe=8, buckets=4)


def words(i):
    """Texts over a few words, some rare."""
    return " ".join(f"w{(i * 7 + j * j) % (5 + i % 11)}" for j in range(3 + i % 9)) + (f" rare{i // 10}" if i % 5 == 0 else "")


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()) if isinstance(texts, dict) else texts, DOC)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def plain_search(texts, queries, k=10, tokens=lambda t: re.findall(r"[^\W_]+", (t or "").lower()), mean=None):
    """BM25 of a dict of live texts, score and id of the k best of each query."""
    held = {i: Counter(tokens(t)) for i, t in texts.items()}
    n, length = len(held), {i: sum(c.values()) for i, c in held.items()}
    mean = mean or sum(length.values()) / max(1, n)
    df = Counter(t for c in held.values() for t in c)
    out = {}
    for q, text in enumerate(queries):
        found = []
        for i, c in held.items():
            hit = sorted(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for t in set(tokens(text)) if t in c)
            if hit:
                found.append((-sum(hit), i))
        out[q] = [(i, round(-s, 9)) for s, i in sorted(found)[:k]]
    return out


def got(index, spark, *queries, **options):
    out = {q: [] for q in range(len(queries))}
    for r in sorted(stored.search(index, asked(spark, *queries), **options).collect(), key=lambda r: (r.qid, r["rank"])):
        out[r.qid].append((r.doc_id, round(r.score, 9)))
    return out


QUERIES = ("w1 w2 rare3", "w0", "rare7 w4 w4", "nothing here", "")


def test_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],)], "t array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(counted(F.col("t"))).collect()] == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]


def test_every_state_is_that_of_a_full_search(spark, index):
    texts = {i: words(i) for i in range(120)}
    index.rebuild(rows(spark, texts))
    assert got(index, spark, *QUERIES) == plain_search(texts, QUERIES)
    new = {i: words(i + 3) for i in range(100, 140)} | {7: None, 8: ""}
    index.upsert(rows(spark, new))
    texts |= new
    assert got(index, spark, *QUERIES, k=4) == plain_search(texts, QUERIES, 4)
    index.delete(spark.createDataFrame([(i,) for i in (*range(0, 140, 3), 5000)], "doc_id long"))
    texts = {i: t for i, t in texts.items() if i % 3}
    assert got(index, spark, *QUERIES) == plain_search(texts, QUERIES)
    index.upsert(rows(spark, {0: "w1 w1 w1", 1: "w2 rare3"}))
    texts |= {0: "w1 w1 w1", 1: "w2 rare3"}
    before = index.snapshot()
    assert got(index, spark, *QUERIES) == plain_search(texts, QUERIES) and len(before.meta["segments"]) == 3
    after = index.compact()
    assert got(index, spark, *QUERIES) == plain_search(texts, QUERIES)
    assert (after.n, after.meta["total"]) == (before.n, before.meta["total"]) == (len(texts), sum(len((t or "").split()) for t in texts.values()))
    want = Counter(t for x in texts.values() for t in set((x or "").split()))
    assert {r.term: r.df for r in before.terms().collect()} == {r.term: r.df for r in after.terms().collect()} == want
    # the old state is there until it is removed
    assert got(index, spark, *QUERIES, snapshot=before) == got(index, spark, *QUERIES)
    assert index.vacuum() and not index.vacuum()
    assert got(index, spark, *QUERIES) == plain_search(texts, QUERIES)
    with pytest.raises(FileNotFoundError):
        index.snapshot(1)


def test_blocks_are_skipped(spark, index):
    common = {i: f"common words in all texts number{i}" for i in range(400)}
    index.rebuild(rows(spark, common | {i: f"common words rarest{i} rarely seldom" for i in (40, 41, 42)}))
    state = index.snapshot()
    found = stored.Search(index, state, asked(spark, "rarest41 rarely seldom common"), k=3)
    every, early, late = (x.count() for x in (found.bounds, found.first, found.second))
    assert every > 50 and early + late < 10
    assert [r.doc_id for r in sorted(found.result().collect(), key=lambda r: r["rank"])] == [41, 40, 42]
    # files of other folders are not opened
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    few, all_ = files(state.postings(found.buckets[:1])), files(state.postings())
    assert few < all_ and all(f"bucket={found.buckets[0]}/" in f for f in few)


def test_a_reader_during_a_rebuild(spark, index):
    texts = {i: words(i) for i in range(30)}
    index.rebuild(rows(spark, texts))
    reader = index.snapshot()
    other = stored.open_store(spark, index.path, stripe=8, buckets=4)
    seen = []
    publish = other._publish

    def watched(base, meta):
        seen.append(got(index, spark, *QUERIES))  # all is written, nothing published
        return publish(base, meta)

    other._publish = watched
    other.rebuild(rows(spark, {1: "w1 only"}))
    assert seen == [plain_search(texts, QUERIES)]
    assert got(index, spark, *QUERIES, snapshot=reader) == plain_search(texts, QUERIES)
    assert got(index, spark, "w1") == plain_search({1: "w1 only"}, ["w1"])


def test_two_writers_and_one_that_dies(spark, index, monkeypatch):
    index.rebuild(rows(spark, {1: "a b"}))
    base = index.snapshot()
    index.upsert(rows(spark, {2: "b"}))
    with pytest.raises(Conflict):
        index._publish(base, {})
    assert index.snapshot().n == 2

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(work, "swap", dies)
    with pytest.raises(KeyboardInterrupt):
        index.upsert(rows(spark, {3: "b"}))
    monkeypatch.undo()
    assert index.snapshot().n == 2
    with pytest.raises(Conflict):
        index.upsert(rows(spark, {4: "b"}))
    assert index.recover().n == 3 and index.upsert(rows(spark, {4: "b"})).n == 4
    assert index.recover().n == 4


def test_odd_rows(spark, index):
    assert got(index, spark, "a") == {0: []} and index.snapshot().n == 0
    index.rebuild(rows(spark, []))
    assert got(index, spark, "a") == {0: []}
    index.rebuild(rows(spark, [(None, "a b"), (None, "a"), (1, "a z"), (1, "a a"), (2, None), (3, "!!")]))
    state = index.snapshot()
    assert state.n == 5 and {r.term: r.df for r in state.terms().collect()} == {"a": 3, "b": 1, "z": 1}
    assert [i for i, _ in got(index, spark, "a")[0]] == [1]
    assert index.delete(spark.createDataFrame([(None,), (3,), (3,)], "doc_id long")).n == 4
    index.upsert(rows(spark, [(None, "a")]))
    assert index.snapshot().n == 5 and index.delete(spark.createDataFrame([], "doc_id long")).n == 5
    queries = spark.createDataFrame([(None, "a"), (5, None), (6, "A z")], "qid long, text string")
    assert [(r.qid, r.doc_id) for r in stored.search(index, queries).collect()] == [(6, 1)]


def test_versions(spark, index):
    of = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string, v long")
    index.rebuild(of((1, "one", 5), (1, "two", 7), (2, "x", None)), version="v")
    index.upsert(of((1, "three", 6), (2, "y", 0)), version="v")
    assert {r.term for r in index.snapshot().terms().collect()} == {"two", "y"}
    index.upsert(of((1, "four", 7)), version="v")
    assert {r.term for r in index.snapshot().terms().collect()} == {"four", "y"}


def test_another_encoder_is_refused(spark, index):
    index.rebuild(rows(spark, {1: "a"}))
    with pytest.raises(ValueError):
        stored.open_store(spark, index.path, "english").snapshot()


def test_stemmed_search(spark, tmp_path):
    index = stored.open_store(spark, str(tmp_path / "index"), "english", stripe=8)
    texts = {0: "He was running and hopes for the best", 1: "The runs of hope", 2: "Hoping, hopping; relational relations", 3: "x" * 41 + " running", 4: "the and of", 5: None}
    index.rebuild(rows(spark, texts))
    tokens = lambda t: [english.stem(w) for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in english.STOP_WORDS and len(w) <= 40]
    queries = ("hopeful runs", "relation of the hop", "the")
    assert got(index, spark, *queries, avg_len=256) == plain_search(texts, queries, tokens=tokens, mean=256)
    assert got(index, spark, "hoped", avg_len=256)[0] and index.snapshot().meta["total"] == sum(len(tokens(t)) for t in texts.values())


def test_stop_words_are_looked_for_once_for_each_distinct_token(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(english, "STOP_WORDS", type("Seen", (frozenset,), {"__contains__": lambda self, w: looked.append(w) or frozenset.__contains__(self, w)})(english.STOP_WORDS))
    lists = pa.array([["the", "runs", "x" * 41], [], ["of", "the"], ["hoping", "the", "runs", "é" * 40]], pa.list_(pa.string()))
    found = [x.to_pylist() for x in english._stems(iter([lists, lists.slice(1), lists.slice(1, 1)]))]
    want = [["run"], [], [], ["hope", "run", "é" * 40]]
    assert found == [want, want[1:], want[1:2]]
    # every token of every text was compared with them before
    assert sorted(looked) == sorted({"the", "runs", "x" * 41, "of", "hoping", "é" * 40})
    plan = english.encode(rows(spark, {1: "The runs"}))._jdf.queryExecution().optimizedPlan().toString()
    assert "whom" not in plan


#: Published pairs of words and their stems.
PAIRS = """
consign consign consigned consign consignment consign consist consist consisted consist consistency consist consistently consist
consolation consol consolatory consolatori consoled consol consolidate consolid consolidating consolid consolingly consol consonant conson
consorting consort conspicuously conspicu conspiracy conspiraci conspirators conspir conspiring conspir constables constabl constancy constanc
knackeries knackeri knacks knack knag knag knaves knave knavish knavish kneaded knead kneeling kneel knees knee knell knell knife knife
knightly knight knitted knit knives knive knobs knob knocker knocker knopp knopp knots knot
generate generat generously generous communism communism community communiti hopping hop hoping hope skies sky dying die news news
proceed proceed exceeded exceed relational relat conditional condit rational ration valency valenc digitizer digit operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl
ties tie cries cri gas gas kiwis kiwi luxuriated luxuri bed bed shred shred sing sing youth youth boyish boyish say say by by
""".split()


def test_published_stems():
    assert {w: english.stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2]))


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "Running the runs, running"), (2, None)], DOC)
    assert sorted(map(tuple, english.dictionary(df).collect())) == [("running", "run"), ("runs", "run")]


def test_same_as_the_search_over_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    index = stored.open_store(spark, work.new_folder(spark, "index"))
    index.rebuild(docs)
    key = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(stored.search(index, queries)) == key(lexical.search(queries, docs))


def test_queries_terms_are_not_sent_with_every_stripe(spark, index, monkeypatch):
    from cairn.operators import lexical

    texts = {i: f"common w{i % 5} number{i}" for i in range(60)}
    index.rebuild(rows(spark, texts))
    index.delete(spark.createDataFrame([(1,), (6,)], "doc_id long"))
    queries = asked(spark, "w1 common", "number7 w2", "absent")
    found = stored.Search(index, index.snapshot(), queries, k=4)
    plan = found.scored(found.first)._jdf.queryExecution().optimizedPlan().toString()
    # lists of terms and of marks stood beside each query of a stripe before
    assert "collect_list" not in plan
    key = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    whole = key(stored.search(index, queries, 4))
    assert not {1, 6} & {r[2] for r in whole} and whole == key(found.result())
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 5)
    assert key(stored.search(index, queries, 4)) == whole


def blocks_of(docs):
    """(stripe, term): ids, counts and lengths, of (stripe, id, len, terms) rows."""
    out = {}
    for stripe, i, length, terms in sorted(docs, key=lambda r: (r[0], -math.inf if r[1] is None else r[1])):
        for t, tf in terms:
            out.setdefault((stripe, t), []).append((i, tf, length))
    return out


@pytest.mark.parametrize("run", [1, 7, 1 << 20])
def test_runs_of_stripes(monkeypatch, run):
    monkeypatch.setattr(store, "RUN_POSTINGS", run)
    docs = [(i // 3, None if i % 8 == 5 else (i * 7) % 40, i % 4, [(f"t{j}", 1 + (i + j) % 3) for j in range(i % 4)]) for i in range(40)]
    kinds = pa.schema([("stripe", pa.int64()), ("id", pa.int64()), ("len", pa.int32()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))])
    whole = pa.RecordBatch.from_arrays([pa.array([[dict(zip(("term", "tf"), t)) for t in x] if k == 3 else x for x in c], kinds[k].type) for k, c in enumerate(zip(*docs))], schema=kinds)
    # batches end within stripes, one is empty
    made = [r for b in store._runs(iter([whole.slice(0, 5), whole.slice(5, 0), whole.slice(5, 17), whole.slice(22)])) for r in b.to_pylist()]
    found = {}
    for r in made:
        assert r["n"] == len(r["ids"]) == r["ends"][-1] and r["first"] == r["stripes"][0] and r["stripes"] == sorted(set(r["stripes"]))
        for stripe, a, b, most, least in zip(r["stripes"], [0, *r["ends"]], r["ends"], r["max_tfs"], r["min_lens"]):
            assert (stripe, r["term"]) not in found and (most, least) == (max(r["tfs"][a:b]), min(r["lens"][a:b]))
            found[stripe, r["term"]] = list(zip(r["ids"][a:b], r["tfs"][a:b], r["lens"][a:b]))
    assert found == blocks_of(docs)
    # the last stripe of a batch may go on, so it is a run of its own
    assert run < 1 << 20 or sum(b.num_rows for b in store._runs(iter([whole]))) == 3 + 3
    assert sum(b.num_rows for b in store._runs(iter([whole.slice(0, 1)]))) == 0


def test_a_segment_has_a_row_for_each_term_of_a_run(spark, index):
    texts = {i: f"common w{i % 5} number{i}" for i in range(60)}
    state = index.rebuild(rows(spark, texts).coalesce(1))
    folder = state.meta["segments"][0]["folder"]
    held = spark.read.parquet(f"{index.path}/{folder}/postings")
    # a row for each term and stripe before, 8 for the common one; the last stripe of 4 is a run of its own
    assert held.count() == 1 + 5 + 56 + 1 + 4 + 4 and held.filter("term = 'common'").count() == 2
    blocks = state.postings()
    assert blocks.filter("term = 'common'").count() == 8 and blocks.agg(F.sum("n")).first()[0] == 180
    key = lambda df: sorted((r.seg, r.stripe, r.term, r.n, r.max_tf, r.min_len, r.ids, r.tfs, r.lens) for r in df.collect())
    assert {(b[1], b[2]): list(zip(*b[6:])) for b in key(blocks)} == blocks_of((r.stripe, r.id, r.len, r.terms) for r in state.documents().collect())
    # summaries are read without the postings
    plan = blocks.select("seg", "stripe", "term", "max_tf", "min_len")._jdf.queryExecution().executedPlan().toString()
    assert "min_lens" in plan and "tfs:array" not in plan.replace("max_tfs:array", "")
    # a segment that holds blocks themselves, as they were written before
    blocks.drop("seg").withColumn("bucket", store.bucket_of(F.col("term"), index.buckets)).write.partitionBy("bucket").parquet(f"{index.path}/earlier/postings")
    earlier = store.Snapshot(spark, index.path, state.meta | {"segments": [state.meta["segments"][0] | {"folder": "earlier"}]})
    assert key(earlier.postings()) == key(blocks)


def test_documents_are_not_moved_for_marks(spark, index, monkeypatch):
    texts = {i: words(i) for i in range(60)} | {7: None}
    index.rebuild(rows(spark, [*texts.items(), (None, "w1 w2")]))
    index.upsert(rows(spark, {i: words(i + 1) for i in range(50, 70)}))
    state = index.delete(spark.createDataFrame([(i,) for i in range(0, 70, 9)], "doc_id long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = lambda: sorted(((r.seg, r.stripe, r.id, r.len, sorted(map(tuple, r.terms))) for r in state.documents().collect()), key=str)
        live = key()
        # documents with their terms were exchanged and sorted before
        assert "SortMergeJoin" not in state.documents()._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(store, "SENT_MARKS", 0)
        assert "SortMergeJoin" in state.documents()._jdf.queryExecution().executedPlan().toString() and key() == live
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r[2] for r in live if r[2] is not None) == [i for i in range(70) if i % 9] and len(live) == 63 == state.n
