"""Document fingerprints of closed syncmers; DataFrame functions only.

A text is read as tokens: runs of letters, marks, digits and underscores; single letters of
scripts that write without spaces; runs of anything else but white space. Of the K-mers of
tokens those are chosen whose least hash of the S-mers inside stands at the first or the
last place. That looks at the K-mer alone, so a passage has the same anchors in whatever
text it stands, and two neighbours are at most K - S tokens apart.

A fingerprint is the sequence of anchors, eight hex digits each: 28 bits of the K-mer's
hash, and how many tokens the anchor before is away. Anchors are matched by position: two
neighbours count as found in another fingerprint if the same two K-mers stand there at the
same distance, so a match lies on one diagonal wherever the passage moved to. The likeness
is the Dice share of such links. All work on a text is linear in its length and stays in
its row.

The next document is the one after it by descending doc_id, and the first one after the
last. Rows are dealt into buckets by cut points over the ids; each bucket also gets, as a
guest, the first document of the bucket that follows. So one exchange brings every document
beside its next one, and no window holds more than a bucket.

Defined cases: a null text counts as empty; a text without tokens has the fingerprint ""
and is like another such one (1) and unlike the rest (0); one with fewer than K tokens, or
in which no K-mer is chosen, has one anchor of all its tokens, and no link but itself;
equal texts have equal fingerprints; rows without a doc_id come last; rows that share an
id are ordered by a hash of their texts; a single document is its own next one; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, tasks_for

K, S = 6, 2
"""Tokens of a K-mer and of the S-mers inside; S divides K."""

_NO_SPACES = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{_NO_SPACES}]|[\p{{L}}\p{{M}}\p{{N}}_&&[^{_NO_SPACES}]]++|[^\s\p{{L}}\p{{M}}\p{{N}}_]++"
HASH_BITS = (1 << 28) - 1
BUCKETS_PER_TASK = 4
MOST_BUCKETS = 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(h: Column) -> Column:
    """Where closed syncmers begin, by the hashes of all S-mers: one of the least stands at an edge."""
    w = K - S + 1
    at = lambda i, n: F.get(h, i + n)

    def closed(i: Column) -> Column:
        first, last = at(i, 0), at(i, w - 1)
        return (first <= F.least(*(at(i, n) for n in range(1, w)))) | (last <= F.least(*(at(i, n) for n in range(w - 1))))

    return F.filter(F.sequence(F.lit(0), F.size(h) - w), closed)


def _of_anchors(a: Column, p: Column) -> Column:
    """Fingerprint and links of anchors and their places."""
    far = lambda i: F.when(i > 0, F.get(p, i) - F.get(p, i - 1)).otherwise(0)
    marks = F.transform(a, lambda x, i: F.concat(F.lpad(F.hex(x), 7, "0"), F.hex(far(i))))
    pairs = F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.xxhash64(F.get(a, i - 1), far(i), F.get(a, i)))
    links = F.when(F.size(a) > 1, F.array_distinct(pairs)).otherwise(F.transform(a, lambda x: F.xxhash64(x)))
    return F.struct(F.lower(F.array_join(marks, "")).alias("fingerprint"), links.alias("links"))


def traits(text: Column) -> Column:
    """struct(fingerprint string, links array<bigint>) of a text."""

    def of_tokens(t: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(t) - S), lambda i: F.xxhash64(*(F.get(t, i + n) for n in range(S))))
        anchor = lambda h: lambda i: F.xxhash64(*(F.get(h, i + n) for n in range(0, K, S))).bitwiseAND(F.lit(HASH_BITS))
        # a text in which no K-mer is chosen is one anchor as a whole
        alone = F.when(F.size(t) > 0, F.array(F.xxhash64(t).bitwiseAND(F.lit(HASH_BITS)))).otherwise(F.array().cast("array<bigint>"))
        few = _let(alone, lambda a: _of_anchors(a, F.array(F.lit(0))))
        of_places = lambda h: lambda p: F.when(F.size(p) > 0, _let(F.transform(p, anchor(h)), lambda a: _of_anchors(a, p))).otherwise(few)
        return F.when(F.size(t) >= K, _let(inner, lambda h: _let(_places(h), of_places(h)))).otherwise(few)

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), of_tokens)


def likeness(a: Column, b: Column) -> Column:
    """Dice share of the links of two fingerprints, 0 to 1; two empty ones are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _cut_points(docs: DataFrame, key: Column, n: int) -> list[int]:
    """n - 1 ids that part the rows evenly; an id with very many rows is there more than once."""
    if n < 2:
        return []
    found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("cuts")).first()["cuts"]
    return sorted(found or [])


def _bucket(key: Column, tie: Column, cuts: list[int]) -> Column:
    """The place among the cut points, looked up in two steps; rows of an id that is a cut point are dealt by their tie, in its order."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    rows = F.from_json(F.lit(json.dumps([cuts[i : i + width] for i in range(0, len(cuts), width)])), "array<array<bigint>>")

    def below(test: Callable[[Column], Column]) -> Column:
        whole = F.size(F.filter(rows, lambda r: test(F.get(r, 0))))
        return F.when(whole > 0, (whole - 1) * width + F.size(F.filter(F.get(rows, whole - 1), test))).otherwise(0)

    low, high = below(lambda c: c < key), below(lambda c: c <= key)
    share = F.shiftrightunsigned(tie, 11).cast("double") / F.lit(float(1 << 53))
    return (low + F.floor(share * (high - low + 1))).cast("int")


def _beside_next(docs: DataFrame, buckets: int | None) -> tuple[DataFrame, object]:
    """Rows id, text, bucket, guest, and the window in which each document's next one follows it."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = buckets or min(MOST_BUCKETS, max(BUCKETS_PER_TASK * partitions(spark), tasks_for(docs)))
    cuts = _cut_points(docs, key, n)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    # ties are ordered as unsigned numbers, as they are dealt
    rows = rows.withColumn("order", F.lpad(F.hex("tie"), 16, "0")).withColumn("bucket", _bucket(F.col("key"), F.col("tie"), cuts)).withColumn("guest", F.lit(False))
    first = rows.groupBy("bucket").agg(F.max_by("text", F.struct(F.col("id").isNotNull(), "key", "order")).alias("text"))
    filled = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # a number for each bucket
    follows = dict(zip(filled, [filled[-1], *filled[:-1]])) if filled else {}
    before = spark.createDataFrame([(b, c) for c, b in follows.items()], "bucket int, host int").coalesce(1)
    guests = first.join(before, "bucket").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("id"), "text", F.lit(0).cast("long").alias("key"), F.lit("").alias("order"), F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    window = Window.partitionBy("bucket").orderBy("guest", F.col("id").isNull(), F.desc("key"), F.desc("order"))
    return rows.drop("tie").unionByName(guests), window


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third of code points replaced by as many of the next document's first ones.
    """
    rows, window = _beside_next(docs, buckets)
    third = F.floor(F.length("text") / 3).cast("int")
    pairs = rows.withColumn("follower", F.lead("text").over(window))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.coalesce("follower", F.lit("")), F.lit(1), third))
    pairs = pairs.select("id", "bucket", "guest", "key", "order", F.length("text").cast("long").alias("n_chars"), traits(F.col("text")).alias("own"), edited.alias("edited"))
    pairs = pairs.withColumn("next_links", F.lead("own.links").over(window)).filter("NOT guest")
    pairs = pairs.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", traits(F.col("edited")).alias("other"), "next_links")
    return pairs.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("own.fingerprint").alias("fingerprint"),
        F.col("other.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("own.links"), F.col("other.links")).alias("near_edited"),
        likeness(F.col("own.links"), F.col("next_links")).alias("near_next"),
    )
