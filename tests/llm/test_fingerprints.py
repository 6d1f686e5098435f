"""Closed syncmers against a plain version that looks at every K-mer anew."""

import hashlib
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from cairn.llm import fingerprints

K, S = 6, 2
NO_SPACES = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
TOKEN = regex.compile(rf"(?V1)[{NO_SPACES}]|[[\p{{L}}\p{{M}}\p{{N}}_]--[{NO_SPACES}]]+|[^ \t\n\x0b\f\r\p{{L}}\p{{M}}\p{{N}}_]+")
MASK = (1 << 28) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*values):
    """Spark's hash of several columns: each is hashed with the hash before as seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h)
    return h


def number(x, size=8):
    return struct.pack("<q" if size == 8 else "<i", signed(x) if size == 8 else x)


def plain(text):
    t = TOKEN.findall(text or "")
    if not t:
        return "", set()
    p = []
    if len(t) >= K:
        inner = [chain(t[i], t[i + 1]) for i in range(len(t) - S + 1)]
        least = lambda xs: min(map(signed, xs))
        p = [i for i in range(len(t) - K + 1) if least(inner[i : i + K - S + 1]) in (signed(inner[i]), signed(inner[i + K - S]))]
        a = [chain(*(number(inner[i + n]) for n in range(0, K, S))) & MASK for i in p]
    if not p:
        a, p = [chain(*t) & MASK], [0]
    far = [0, *(y - x for x, y in zip(p, p[1:]))]
    assert max(far) <= K - S
    links = {chain(number(x), number(d, 4), number(y)) for x, d, y in zip(a, far[1:], a[1:])} if len(a) > 1 else {chain(number(a[0]))}
    return "".join(f"{x:07x}{d:x}" for x, d in zip(a, far)), links


def alike(x, y):
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def plain_rows(rows):
    """Rows without repeated ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        (own, x), (other, y), (_, z) = plain(text), plain(edited), plain(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, alike(x, y), alike(x, z)))
    return out


def got(df, **options):
    return sorted(map(tuple, fingerprints.fingerprints(df, **options).collect()), key=str)


def test_given_documents(small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert got(small) == sorted(plain_rows(rows), key=str)


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_any_number_of_buckets(docs_of, buckets):
    rows = [(10**18 if i == 5 else i * i, f"the {i} of {i + 1} and one more word, then the end of it {i % 4}") for i in range(30)]
    assert got(docs_of(rows, extra=True), buckets=buckets) == sorted(plain_rows(rows), key=str)


def test_odd_texts(docs_of):
    texts = [None, "", " \n\t ", "one", "two words", "、。!?" * 9, "语言模型需要很多干净的文本才能学好" * 3, "a" * 100_000, "na " * 20_000, " " * 1_000_000, "\U0001f600 " * 40, "x y z é é " * 9, "w " * 5 + "end"]
    rows = list(enumerate(texts)) + [(None, "no id at all here, none")]
    assert got(docs_of(rows), buckets=3) == sorted(plain_rows(rows), key=str)


def test_one_document_follows_itself(docs_of):
    (row,) = got(docs_of([(4, "abcdefghi jkl")]))
    assert row[2] == hashlib.sha256(b"abcdefghiabcd").hexdigest() and row[6] == 1.0


def test_empty_table(docs_of):
    assert got(docs_of([])) == []


def test_repeated_rows_and_ids(docs_of):
    rows = [(1, "same text here")] * 3 + [(1, "another text with the id")] + [(None, "a")] * 2 + [(2, "second")]
    out = fingerprints.fingerprints(docs_of(rows), buckets=4)
    assert out.count() == len(rows)
    assert out.filter("n_chars = 14").select("fingerprint").distinct().count() == 1
    # most of an id's rows in one bucket's ids: they are dealt by their texts
    many = docs_of([(7, f"text number {i} of an id that very many rows share") for i in range(400)] + [(i, "x") for i in range(20)])
    cuts = fingerprints._cut_points(many, F.col("doc_id"), 8)
    dealt = many.select(fingerprints._bucket(F.col("doc_id"), F.xxhash64("text"), cuts).alias("b"), F.hex(F.xxhash64("text")).alias("t"), "doc_id")
    assert dealt.groupBy("b").count().agg(F.max("count")).first()[0] < 120
    assert fingerprints.fingerprints(many, buckets=8).count() == 420


def test_moved_passages_match_by_position(spark):
    passage = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"else{i}" for i in range(300))
    row = spark.createDataFrame([(passage, f"{other} {passage}", other, " ".join(reversed(passage.split())))], "a string, b string, c string, d string")
    near = lambda x, y: fingerprints.likeness(fingerprints.traits(F.col(x))["links"], fingerprints.traits(F.col(y))["links"])
    moved, apart, back = row.select(near("a", "b"), near("a", "c"), near("a", "d")).first()
    assert moved > 0.6 and apart == 0 and back < 0.05


def test_no_python_in_the_plan(small):
    plan = fingerprints.fingerprints(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    # one exchange brings each document beside its next one; the other is of a text for each bucket
    assert plan.split("== Physical Plan ==")[1].count("Window ") == 2
