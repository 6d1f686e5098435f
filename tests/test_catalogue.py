import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from cairn.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations embeddings events orders"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.NAMES)
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    if name not in oracles.ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(oracles.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_ingest_leaves_names_in_embeds(spark, tmp_path):
    texts = ["x Rend Rend y", "Rend\nRend Rend", "<:fsoa:1> <:zz:2>", "Powder of Penance <:powderofpenance:1>", "Soul Split Soul Split 50%+", "Rend", "", None]
    docs = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts * 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracles.ORACLES["ingest_corpus"])
    names = [c[0] for c in want.description]
    got = __spark_entry__.queries()["ingest_corpus"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    ignore = lambda folder, names: {"llm", "__pycache__", ".git"} & set(names)
    shutil.copytree(f"{root}/cairn", tmp_path / "cairn", ignore=ignore)
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), str(len(oracles.ORACLES))]


def test_what_is_missing_inside_the_training_data_operators_is_an_error(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    ignore = lambda folder, names: {"llm", "__pycache__", ".git"} & set(names)
    shutil.copytree(f"{root}/cairn", tmp_path / "cairn", ignore=ignore)
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "cairn" / "llm").mkdir()
    (tmp_path / "cairn" / "llm" / "__init__.py").write_text("")
    (tmp_path / "cairn" / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode and "a_library_that_is_not_there" in out.stderr
