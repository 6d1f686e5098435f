import os

import pytest
from pyspark.sql import functions as F

from cairn.operators import relevance, results, stored
from cairn.sources import registry
from cairn.streaming import incremental


def logging_model(folder, die=None, fail=lambda t: False):
    """A model that writes down what it is asked, in a file for each worker; it kills its worker at one text."""

    def model(texts):
        with open(f"{folder}/asked-{os.getpid()}", "a", encoding="utf-8") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if die in texts:
            os._exit(9)
        if any(fail(t) for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    return model


def asked(folder):
    return sorted(line for f in os.listdir(folder) for line in open(f"{folder}/{f}", encoding="utf-8").read().splitlines())


def folder_in(tmp_path, name):
    (tmp_path / name).mkdir()
    return str(tmp_path / name)


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_texts_are_asked_once(spark, tmp_path):
    a, b, path = folder_in(tmp_path, "a"), folder_in(tmp_path, "b"), str(tmp_path / "results")
    got = results.run(rows(spark, ["x", "y", "x", None, ""]), logging_model(a), path).orderBy("id").collect()
    assert [(r.result, r.error) for r in got] == [("X", None), ("Y", None), ("X", None), (None, None), ("", None)] and asked(a) == ["", "x", "y"]
    got = results.run(rows(spark, ["y", "z"]), logging_model(b), path).orderBy("id").collect()
    assert [r.result for r in got] == ["Y", "Z"] and asked(b) == ["z"]
    assert results.run(rows(spark, []), logging_model(b), path).count() == 0


def test_a_killed_run_goes_on(spark, tmp_path):
    a, b, path = folder_in(tmp_path, "a"), folder_in(tmp_path, "b"), str(tmp_path / "results")
    texts = [f"text {i}" for i in range(40)]
    df = rows(spark, texts)
    part = df.select("text", F.pmod(F.xxhash64(F.sha2("text", 256)), F.lit(4)).alias("p"))
    last = part.filter("p = 2").first()["text"]
    with pytest.raises(Exception):  # noqa: B017 - the job fails with its worker
        results.run(df, logging_model(a, die=last), path, parts=4, batch_bytes=20)
    done = {r["text"] for r in part.filter("p < 2").collect()}
    assert results.stored(spark, path).count() == len(done)
    got = results.run(df, logging_model(b), path, parts=4).collect()
    assert {r.text: r.result for r in got} == {t: t.upper() for t in texts}
    assert asked(b) == sorted(set(texts) - done)


def test_failures_are_rows_and_are_tried_again(spark, tmp_path):
    path = str(tmp_path / "results")
    fail = lambda t: "bad" in t
    for n in (1, 2, 3):
        a = folder_in(tmp_path, f"a{n}")
        got = {r.text: (r.result, r.error) for r in results.run(rows(spark, ["ok", "bad 1", "fine"]), logging_model(a, fail=fail), path, tries=2).collect()}
        assert got == {"ok": ("OK", None), "fine": ("FINE", None), "bad 1": (None, "ValueError: no")}
        assert ("bad 1" in asked(a)) == (n < 3) and ("ok" in asked(a)) == (n == 1)
    assert results.ask(lambda t: [None for _ in t], ["a"])[0][0] is None and results.ask(lambda t: [], ["a", "b"])[1][1].startswith("ValueError")


def test_batches_of():
    assert list(results.batches_of(["aa", "b", "éé", "c" * 9, ""], 4)) == [["aa", "b"], ["éé"], ["c" * 9], [""]]


def test_time_quantiles(spark, tmp_path):
    path = str(tmp_path / "times")
    for part in (range(0, 5000), range(5000, 10000)):
        registry.log_times(spark.createDataFrame([(f"run{i % 2}", float((i * 7919) % 10000)) for i in part] + [("run0", None), ("empty", None)], "run_name string, seconds double"), path)
    got = {r.run_name: r for r in registry.time_quantiles(spark.read.parquet(path), {"p50": 0.5, "p95": 0.95}).collect()}
    assert {k: r.n for k, r in got.items()} == {"run0": 5000, "run1": 5000, None: 10000}
    assert all(abs(r.p50 / 10000 - 0.5) <= registry.RANK_ERROR and abs(r.p95 / 10000 - 0.95) <= registry.RANK_ERROR for r in got.values())
    nothing = spark.createDataFrame([], "run_name string, seconds double")
    assert registry.time_quantiles(registry.time_sketches(nothing, "run_name", "seconds"), {"p50": 0.5}).count() == 0


def test_phrases_of_any_length(spark):
    texts = {1: "Alpha beta gamma", 2: "no such thing", 3: "beta", 4: None, 5: "xαβx\nline two", 6: "aaaa aaaa"}
    chunks = spark.createDataFrame([(i, "s", "sec", t) for i, t in texts.items()], "doc_id long, source string, section string, text string")
    phrases = ["a", "bet", "pha be", "thing", "αβ", "x\nli", "zzz", "Alpha beta gamma", "aaaa a", " ", "beta gamma delta", "aa", "such thi"]
    asked = spark.createDataFrame([(q, None, "SEC", p) for q, p in enumerate(phrases)] + [(99, None, "SEC", None)], "qid long, expected_source array<string>, expected_section string, expected_phrase string")
    found = relevance.qrels(asked, chunks)
    assert sorted((r.qid, r.doc_id) for r in found.collect()) == sorted((q, i) for q, p in enumerate(phrases) for i, t in texts.items() if t and p in t)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    none = relevance.qrels(asked.filter("qid = 99"), chunks)
    assert none.count() == 0


def test_a_stream_of_versions_ends_in_the_last_ones(spark, tmp_path):
    store = stored.open_store(spark, str(tmp_path / "index"), stripe=4, buckets=2)
    source = tmp_path / "in"
    source.mkdir()
    arrivals = [[(1, "old one", 1), (2, "two", 1)], [(1, "newest one", 3), (3, "three", 1)], [(1, "late one", 2), (2, "two again", 2), (2, "two again two", 3)]]

    def write(n):
        path = source / f"{n}.json"
        path.write_text("".join(f'{{"doc_id": {i}, "text": "{t}", "version": {v}}}\n' for i, t, v in arrivals[n]))
        os.utime(path, (n + 1, n + 1))

    def stream():
        docs = spark.readStream.schema("doc_id long, text string, version long").option("maxFilesPerTrigger", 1).json(str(source))
        incremental.keep_latest(docs, store, str(tmp_path / "checkpoint")).awaitTermination()

    write(0)
    write(1)
    stream()
    write(2)
    stream()
    stream()
    state = store.snapshot()
    want = {"newest": 1, "one": 1, "three": 1, "two": 1, "again": 1}
    assert {r.term: r.df for r in state.terms().collect()} == want and (state.n, state.meta["total"]) == (3, 6)
    assert state.meta["applied"] == {"documents": 2}
    repeated = store.upsert(spark.createDataFrame(arrivals[0], "doc_id long, text string, version long"), version="version", applied=("documents", 0))
    assert repeated.meta["number"] == state.meta["number"]
    asked = spark.createDataFrame([(0, "two"), (1, "old late")], "qid long, text string")
    assert [(r.qid, r.doc_id) for r in stored.search(store, asked).collect()] == [(0, 2)]
