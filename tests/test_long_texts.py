"""Cleaning costs the length of a text, whatever stands in it."""

import time

import pytest
from pyspark.sql import functions as F

from cairn.functions import bands, clean

MILLION = {
    "spaces inside": ("a" + " " * 1_000_000 + "b", clean.tidy_blank_lines, "a" + " " * 1_000_000 + "b\n"),
    "blanks around": ("\n " * 500_000 + "b" + " \t" * 500_000, clean.tidy_blank_lines, "b\n"),
    "newlines": ("a" + "\n" * 1_000_000 + "b", clean.tidy_blank_lines, "a\n\nb\n"),
    "tokens": ("a  [" + "enrageband500 " * 100_000 + "] b", bands.strip_tokens, "a b"),
    "open bracket": ("a" + " " * 1_000_000 + "[" + "enrageband5 " * 50_000, bands.strip_tokens, None),
    "spaces before no bracket": (" " * 1_000_000 + "x", bands.strip_tokens, None),
    "one bracket after another": ("[enrageband1] " * 70_000 + "x", bands.strip_tokens, " x"),
}


@pytest.mark.parametrize("name", MILLION)
def test_a_million_characters(spark, name):
    text, step, want = MILLION[name]
    df = spark.createDataFrame([(text,)], "text string").cache()
    df.count()
    df.select(F.length(step(F.col("text")))).collect()  # compiles
    start = time.perf_counter()
    (got,) = df.select(step(F.col("text"))).first()
    took = time.perf_counter() - start
    assert got == (text if want is None else want) and took < 2


def test_embeds_with_long_blanks(spark):
    blank = " " * 300_000
    embed = spark.createDataFrame([(("T", f"{blank}a{blank}b{blank}", [("n", f"{blank}v{blank}w{blank}")]),)], "e struct<title:string,description:string,fields:array<struct<name:string,value:string>>>")
    (got,) = embed.select(clean.embed_to_text(F.col("e"))).first()
    assert got == f"### T\na{blank}b\n**n**\nv{blank}w"


def test_embeds_read_the_input_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "a\n{\"title\": \"t\"}\n.embed:json\nb"), (4, ".embed:json")], "k long, text string")
    out = clean.flatten_embeds(df.withColumn("text", clean.expand_tokens(F.col("text"))))
    assert {r.k: r.text for r in out.collect()} == {1: "x", 2: None, 3: "a\n### t\nb", 4: ""}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("aggregate(") <= 1
