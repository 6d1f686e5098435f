"""Relevance labels by predicate, and which questions are asked."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import normalize_text

QUESTION_BYTES = 32 << 20


def _key_word(phrase: Column) -> Column:
    """The longest word of a phrase that stands whole in any text with the phrase: neither its first nor its last; null without one."""
    words = F.split(phrase, r"\s+", -1)
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    return F.get(F.array_sort(inner, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 0)


#: Lengths of the grams that short phrases are looked up by; a phrase takes the longest that it has.
GRAMS = (8, 4, 2, 1)


STEP_CHARS = 1 << 20
"""Characters of texts that are looked through at once; a longer text stands alone."""


def _grams(phrase: str, n: int) -> set[str]:
    """The distinct pieces of n characters, wherever they begin."""
    return {phrase[i : i + n] for i in range(len(phrase) - n + 1)}


class Finder:
    """Which of some grams stand in texts: windows of each length as 64-bit numbers, of which few pass a table of bits and are looked up."""

    NO_CHARACTER = 0x110000
    MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))

    def __init__(self, grams: Iterable[str]):
        self.grams = sorted(set(grams))
        self.kinds = []
        for n in sorted({len(g) for g in self.grams}):
            own = [i for i, g in enumerate(self.grams) if len(g) == n]
            keys = np.array([self._windows(self._points(self.grams[i]), n)[0] for i in own], np.uint64)
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << 16, bool)
            table[self._cell(keys)] = True
            self.kinds.append((n, keys[order], np.array(own, np.int64)[order], table))

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    @classmethod
    def _cell(cls, keys: np.ndarray) -> np.ndarray:
        return (keys * cls.MIX[0]) >> np.uint64(48)

    @classmethod
    def _windows(cls, points: np.ndarray, n: int) -> np.ndarray:
        """A number for each window of n characters, n a power of two: exact for two, beyond that equal windows have equal numbers."""
        at, width = points, 1
        while width < n:
            at = (at[: len(at) - width] << np.uint64(32) | at[width:]) if width == 1 else at[: len(at) - width] * cls.MIX[1] + (at[width:] ^ cls.MIX[2])
            width *= 2
        return at

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of a text, number of a gram), each pair once; beyond two characters a gram may be another's."""
        parts = [x for t in texts for x in (self._points(t), np.array([self.NO_CHARACTER], np.uint64))]
        points = np.concatenate(parts or [np.zeros(0, np.uint64)])
        starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
        pairs = [np.zeros(0, np.int64)]
        for n, keys, own, table in self.kinds:
            if len(points) < n:
                continue
            windows = self._windows(points, n)
            at = np.flatnonzero(table[self._cell(windows)])
            nth = np.minimum(np.searchsorted(keys, windows[at]), len(keys) - 1)
            same = keys[nth] == windows[at]
            text = np.searchsorted(starts, at[same], "right") - 1
            pairs.append(np.unique(text * len(self.grams) + own[nth[same]]))
        return np.divmod(np.concatenate(pairs), max(1, len(self.grams)))


def _steps(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of STEP_CHARS bytes in all, and where they begin."""
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > STEP_CHARS:
            yield begin, texts.slice(begin, i - begin).to_pylist()
            begin, held = i, 0
        held += n
    yield begin, texts.slice(begin).to_pylist()


def _by_rarest_gram(have: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Chunks without their texts and the questions whose phrases they contain, found by the rarest of a phrase's grams.

    One pass counts in how many chunks each gram stands, a row for each task and gram; a second looks only for the rarest of each
    phrase, and for the phrase where that stands. Nothing else leaves a task.
    """
    sc = have.sparkSession.sparkContext
    # the phrases of a block of questions: of bounded bytes, as the block is
    grams = {r["phrase"]: sorted(_grams(r["phrase"], r["grams"])) for r in asked.select("phrase", "grams").distinct().collect()}
    unsure = sc.broadcast(Finder(g for own in grams.values() if len(own) > 1 for g in own))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = unsure.value
        n = np.zeros(len(finder.grams), np.int64)
        for batch in batches:
            for _, texts in _steps(batch.column(0)):
                n += np.bincount(finder.find(texts)[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["gram", "n"])

    held = dict.fromkeys(unsure.value.grams, 0)
    if held:
        for r in have.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            held[unsure.value.grams[r["gram"]]] = r["n"]
    rarest: dict[str, list[str]] = {}
    for phrase, own in grams.items():
        least = min(own, key=lambda g: held.get(g, 1))
        # a phrase with a gram that no text has is in no text
        if held.get(least, 1):
            rarest.setdefault(least, []).append(phrase)
    shared = sc.broadcast((Finder(rarest), rarest))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, phrases = shared.value
        for batch in batches:
            for begin, texts in _steps(batch.column(3)):
                met = [(i, p) for i, g in zip(*(x.tolist() for x in finder.find(texts))) for p in phrases[finder.grams[g]] if p in texts[i]]
                own = [batch.column(c).take(pa.array([begin + i for i, _ in met], pa.int64())) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([p for _, p in met], pa.string())], names=[key, "source", "section", "own_phrase"])

    kinds = ", ".join(f"`{c}` {have.schema[c].dataType.simpleString()}" for c in (key, "source", "section"))
    met = have.select(key, "source", "section", "text").mapInArrow(meet, f"{kinds}, own_phrase string")
    return met.join(F.broadcast(asked), F.col("own_phrase") == F.col("phrase"))


def qrels(questions: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """qid, key, grade 1 where a chunk answers: source allowed, section and phrase contained.

    Questions meet the chunks that hold a word of their phrase, by an equality join; what they meet is verified.
    Phrases without such a word (of one or two words) meet the chunks that hold the rarest of their grams. A block of
    questions is held to about QUESTION_BYTES before it goes to every task of a scan; more questions take more blocks.
    """
    want = questions.select("qid", "expected_source", normalize_text(F.col("expected_section")).alias("want"), F.coalesce("expected_phrase", F.lit("")).alias("phrase"))
    want = want.filter("want <> '' AND phrase <> ''").withColumn("key_word", _key_word(F.col("phrase")))
    any_source = F.coalesce(F.size("expected_source"), F.lit(0)) <= 0
    have = chunks.select(key, "source", normalize_text(F.col("section")).alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    same = (any_source | F.array_contains("expected_source", F.col("source"))) & F.col("section").contains(F.col("want"))
    # a phrase's grams go to every task as well
    size = (1 + F.when(F.col("key_word").isNull(), GRAMS[0]).otherwise(0)) * F.octet_length("phrase") + F.octet_length("want") + F.octet_length(F.concat_ws("", "expected_source"))
    size = size + 16 * F.greatest(F.coalesce(F.size("expected_source"), F.lit(0)), F.lit(0)) + 64
    gram = F.when(F.col("key_word").isNotNull(), 0)
    for n in GRAMS:
        gram = gram.when(F.length("phrase") >= n, n)
    want = want.withColumn("grams", gram)
    short = F.col("grams") > 0
    kinds = want.groupBy(short.alias("short")).agg(F.sum(size.cast("long")).alias("n")).collect()  # two rows at most
    # only words are multiplied before the join; the text is looked at where a key word was met
    words = have.withColumn("word", F.explode(F.array_distinct(F.split("text", r"\s+", -1))))
    found = []
    for kind in kinds:
        own = want.filter(short == kind["short"])
        blocks = max(1, -(-kind["n"] // QUESTION_BYTES))
        # by the whole question, as a qid may stand often
        block = F.pmod(F.xxhash64("qid", "want", "phrase"), F.lit(blocks))
        for b in range(blocks):
            asked = own.filter(block == b) if blocks > 1 else own
            if kind["short"]:
                met = _by_rarest_gram(have, asked, key)
            else:
                met = words.join(F.broadcast(asked), F.col("word") == F.col("key_word")).filter(F.col("text").contains(F.col("phrase")))
            found.append(met.filter(same))
    if not found:
        found = [have.join(F.broadcast(want), F.lit(False))]
    return reduce(DataFrame.unionByName, (x.select("qid", key, F.lit(1).alias("grade")) for x in found))


def qrels_size(labels: DataFrame) -> DataFrame:
    return labels.groupBy("qid").agg(F.count("*").alias("n_relevant"))


def unlabelled(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions with a phrase that no chunk answers."""
    return questions.filter("coalesce(expected_phrase, '') <> ''").join(labels, "qid", "left_anti").select("qid")


def stratified_limit(questions: DataFrame, n: int | None, order: str = "qid") -> DataFrame:
    """max(1, n // 4) unanswerable questions and the rest answerable, first ones first; all without a limit."""
    if not n:
        return questions
    few = max(1, n // 4)
    nth = F.row_number().over(Window.partitionBy("answerable").orderBy(order))
    return questions.withColumn("_nth", nth).filter(F.col("_nth") <= F.when(F.col("answerable"), n - few).otherwise(few)).drop("_nth")
