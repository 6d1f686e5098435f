"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Each source's share of 150 % of all words is cut to twice its size, the excess going to
the others by weight (water-filling over the table of sources). A document then has the
fraction f = target / size of its source as expected copies: the whole part is taken, the
rest is a probability that dependent rounding makes 0 or 1. Two documents meet, and words
move at random from one to the other until one of them is whole; both the expected words
of each and the sum of the pair stay as they were. The other goes on to the next meeting.

The meetings form a reduction tree: documents are dealt into groups of about ``fan_in``
by a hash of their row, each group is folded into one residual in a native aggregate, and
the residuals are dealt anew, until a source has one. So a hot source has many small
groups, and its taken words differ from the target by less than one document's size.

Rows alike in doc_id, source and size are counted before they meet any other: among m of
them, each with probability p, meetings leave floor(m p) taken, one residual of what is
over, and the rest not taken, whichever meets whichever. So repeats cost the tree one
residual, however many they are.

Randomness is a hash of the two documents and the seed: reruns agree.

Defined cases: null text has size 0 and takes 0 words; a null source is a source of its
own, last in order; repeated rows each give a row; rows without a doc_id count as alike if source and
size are; a null doc_id is kept; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tasks_for, with_copies

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def _numbered(by_source: DataFrame) -> DataFrame:
    """The table of sources with ``nth`` (from 0) by code point, null last: ranges of sources are numbered each on its own and shifted by the counts of those before."""
    # the range a source falls into is written down with it
    ranged = by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "sources")
    # as many rows as ranges
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("own", own).join(before, "range").withColumn("nth", F.col("before") + F.col("own")).drop("range", "own", "before")


def targets(by_source: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")).cast("double")
    table = _numbered(by_source).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    table = materialize(table.select("source", "source_size", "weight", "cap"), "weights")
    total, open_weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share), F.sum("weight")).first()
    # what sources at their caps leave is shared again by weight, until no other source rises above its cap
    level, n_full = (float(total) / open_weight if open_weight else 0.0), 0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, open_weight = table.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == n_full or not open_weight:
            break
        level, n_full = (float(total) - caps) / open_weight, n
    target = F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _fold(items: Column, seed: int) -> Column:
    """Folds documents struct(key, doc_id, size, p) into struct(rest, done): a residual and those made whole."""
    kind = "struct<key:bigint,doc_id:bigint,size:bigint,p:double>"
    start = F.struct(F.element_at(items, 1).cast(kind).alias("rest"), F.expr(f"cast(array() as array<{kind}>)").alias("done"))

    def meet(state: Column, b: Column) -> Column:
        a = state["rest"]
        own = lambda x, p: F.struct(x["key"].alias("key"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"))
        ma, mb = a["p"] * a["size"], b["p"] * b["size"]
        room_a, room_b = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
        up, down = F.least(room_a, mb), F.least(ma, room_b)  # words to a, or to b
        to_a = _unit(a["key"], b["key"], F.lit(seed)) * (up + down) < down
        # the side that is whole is set to 0 or 1 itself, so no rounding error stays
        a_up = F.when(room_a <= mb, F.lit(1.0)).otherwise(a["p"] + mb / a["size"])
        b_up = F.when(mb <= room_a, F.lit(0.0)).otherwise(b["p"] - room_a / b["size"])
        a_down = F.when(ma <= room_b, F.lit(0.0)).otherwise(a["p"] - room_b / a["size"])
        b_down = F.when(room_b <= ma, F.lit(1.0)).otherwise(b["p"] + ma / b["size"])
        new_a, new_b = own(a, F.when(to_a, a_up).otherwise(a_down)), own(b, F.when(to_a, b_up).otherwise(b_down))
        a_whole = new_a["p"].isin(0.0, 1.0)
        return F.struct(F.when(a_whole, new_b).otherwise(new_a).alias("rest"), F.concat(state["done"], F.array(F.when(a_whole, new_a).otherwise(new_b))).alias("done"))

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, meet)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, fan_in: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    tasks = tasks_for(docs)
    sized = materialize(sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("alike")), "sizes", tasks)
    by_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    shares = targets(by_source.select("source", "source_size"), share, most, weights)
    shares = materialize(shares.join(by_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "shares")
    # every row learns its source's figures: sources are few beside rows, and a hot one is split by the salt
    salts = 16
    salted = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("source", "s")
    rows = sized.withColumn("key", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("salt", F.pmod(F.col("key"), F.lit(salts)).cast("int"))
    rows = rows.join(salted, F.col("source").eqNullSafe(F.col("s")) & (rows.salt == salted.salt)).drop("salt", "s")
    rows = rows.withColumn("f", F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0))
    rows = rows.withColumn("base", F.floor("f")).withColumn("p", F.col("f") - F.col("base"))
    # rows alike settle among themselves; what is over of them goes to the tree as one document
    rows = rows.withColumn("p", F.col("p") * F.col("alike")).withColumn("ones", F.floor("p")).withColumn("p", F.col("p") - F.col("ones"))
    rows = materialize(rows, "fractions", tasks)

    final = ["doc_id", "source", "size", "source_size", "target", "base", "extra"]
    zeros = F.col("alike") - F.col("ones") - (F.col("p") > 0).cast("long")
    settled = F.inline(F.array(*(F.struct(F.lit(x).alias("extra"), n.alias("times")) for x, n in ((1, F.col("ones")), (0, zeros)))))
    done = [with_copies(rows.select(*final[:-1], settled), "times")]
    open_ = rows.filter("p > 0").select("source", "source_size", "target", "base", "n", F.struct("key", F.col("doc_id").cast("long").alias("doc_id"), "size", "p").alias("item"))
    level, left = 0, rows.agg(F.max("n")).first()[0] or 0
    own = ["source", "source_size", "target", "base"]
    while left:
        group = F.when(F.col("n") <= fan_in, F.lit(0)).otherwise(F.pmod(F.xxhash64("item.key", F.lit(level)), F.ceil(F.col("n") / fan_in)))
        grouped = open_.withColumn("g", group.cast("long")).groupBy(*own, "n", "g").agg(
            # the largest first: what stays over at the end tends to be small
            F.array_sort(F.collect_list("item"), lambda a, b: F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("items")
        )
        folded = materialize(grouped.select(*own, "n", "g", _fold(F.col("items"), seed + level).alias("x")), f"level{level}", tasks)
        whole = folded.select(*own, F.explode("x.done").alias("i"))
        done.append(whole.select("i.doc_id", "source", "i.size", "source_size", "target", "base", F.col("i.p").cast("int").alias("extra")).select(final))
        rest = folded.select(*own, "n", F.col("x.rest").alias("item"))
        last = F.col("n") <= fan_in
        ended = rest.filter(last | F.col("item.p").isin(0.0, 1.0))
        extra = F.when(F.col("item.p") >= 1, 1).when(F.col("item.p") <= 0, 0).otherwise((_unit(F.col("item.key"), F.lit(seed - 1)) < F.col("item.p")).cast("int"))
        done.append(ended.select("item.doc_id", "source", "item.size", "source_size", "target", "base", extra.alias("extra")).select(final))
        open_ = rest.filter(~last & ~F.col("item.p").isin(0.0, 1.0)).withColumn("n", F.ceil(F.col("n") / fan_in))
        left = -(-left // fan_in) if left > fan_in else 0
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.withColumn("copies", (F.col("base") + F.col("extra")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Copies find their rows by doc_id, source and size; rows alike in these are numbered on both sides.
    """
    own = ["doc_id", "source", "size"]
    counted = mix(docs, **options).select(*(F.col(c).alias(f"m_{c}") for c in own), "copies")
    counted = counted.withColumn("m_nth", F.row_number().over(Window.partitionBy(*(f"m_{c}" for c in own)).orderBy("copies")))
    sized = docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    sized = sized.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64("text"))))
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in [*own, "nth"]]
    joined = sized.join(counted.filter("copies > 0"), same)
    return joined.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)
