"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Features are whole words, and beside a longer word its first ``STEM`` letters, under which
its forms meet; where a script has no spaces, every pair of neighbouring characters. Every
feature of the labelled examples counts. A feature's weight in a text is (1 + log count)
times its inverse document frequency over the whole corpus times the difference between
its inverse document frequencies in the two classes of examples (delta TF-IDF), smoothed,
so that a feature as frequent in both weighs nothing. Features that no example has tell
nothing about labels and weigh nothing either.

The examples form a block-max inverted index: postings of each feature by example, and
for each feature and block of examples the largest weight. Postings are read by falling
weight until what is left can add little; with the block maxima of the features not read,
only examples that can still reach the k-th best sum so far are scored in full. What is
found is exactly the k nearest. Examples with the very feature counts of the text take
no part, so no row's own label is in its score and a copy of an example is scored by what
lies around it. Votes are weighted by similarity and by how many labels of its kind an
example stands for, and pulled towards the base rate. A logistic curve, fitted to the
examples' own votes with each weighted alike, calibrates the share of votes: scores are
probabilities of label 1. Texts without a similar example get the base rate, the rate of
label 1 among examples without a feature or else among all.

The one bound is a documented parameter: ``per_class`` examples of each label (those with
the smallest hash). What the driver holds are their features and counts.

Labels count only where crc32(doc_id as text) mod 5 is not 0. Inputs of a score are the
text alone.

Defined cases: null and empty texts have no features and get the base rate; labels null
or not 0/1 are ignored, and where one document has several the largest counts; no usable
label at all gives every text the score 0, and labels of one class their own value;
repeated rows each give a row; a null doc_id is not held out; other columns are ignored
unless carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import files_for, give_back, materialize, tasks_for

FOLDS = 5
STEM = 4
STEP_BYTES = 1 << 20
"""Bytes of texts whose words stand as Python objects at once."""
#: Letters of scripts that write without spaces.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]+")
_PLAIN = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else 32 for i in range(256))
_RUN = re.compile(f"[{_UNSPACED}]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _spaced(text: str | None) -> bytes:
    """The words of a text with a space between."""
    if not text or text.isascii():
        return (text or "").encode().translate(_PLAIN)
    return _GAP.sub(" ", text.lower()).encode()


def _parts(word: str) -> list[str]:
    """The features of a word, repeats included; a first part of a word ends in a hyphen, which no word has."""
    if not word.isascii() and _RUN.search(word):
        pairs = [run[at : at + 2] for run in _RUN.findall(word) for at in range(max(1, len(run) - 1))]
        return pairs + [other for other in _RUN.split(word) if other]
    return [word, word[:STEM] + "-"] if len(word) > STEM else [word]


def features_of(text: str | None) -> Counter:
    """How often each feature stands in the whole text."""
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in _parts(word):
            found[f] += n
    return found


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... to n[0] of them, and so on for each start."""
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def numbered(texts: list[str | None], features: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text, places of its features among these, rising, and their counts; each distinct word is looked up once for all texts."""
    words = pc.ascii_split_whitespace(pa.array(map(_spaced, texts), pa.string()))
    coded = words.flatten().dictionary_encode()
    known = coded.dictionary
    place = lambda x: pc.index_in(x, features).fill_null(-1).to_numpy()
    first = pc.binary_join_element_wise(pc.utf8_slice_codeunits(known, 0, STEM), "-", "")
    both = np.stack([place(known), np.where(pc.greater(pc.utf8_length(known), STEM).to_numpy(zero_copy_only=False), place(first), -1)], 1)
    odd = {}
    for at in np.flatnonzero(~pc.string_is_ascii(known).to_numpy(zero_copy_only=False)):
        if _RUN.search(word := known[at].as_py()):
            odd[at] = _parts(word)
    both[list(odd)] = -1
    more = place(pa.array([f for x in odd.values() for f in x], pa.string()))
    flat = np.r_[both.ravel(), more].astype(np.int64)
    owner = np.r_[np.repeat(np.arange(len(known)), 2), np.repeat(np.array(list(odd), np.int64), [len(x) for x in odd.values()])]
    owner, flat = owner[flat >= 0], flat[flat >= 0]
    order = np.argsort(owner, kind="stable")
    flat, each = flat[order], np.bincount(owner, minlength=len(known))
    ends = words.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    pair, times = np.unique(doc * max(1, len(known)) + coded.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(pair, max(1, len(known)))
    n = each[word]
    key = np.repeat(doc, n) * max(1, len(features)) + flat[_places((np.cumsum(each) - each)[word], n)]
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.repeat(times, n)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    doc, fid = np.divmod(key[first], max(1, len(features)))
    return np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))], fid, np.add.reduceat(times, first) if len(first) else times


def class_difference(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """Size of the difference of inverse document frequencies; each class is smoothed by one text with the rate of both."""
    rate = (n0 + n1) / max(1, all0 + all1)
    return np.abs(np.log((n1 + rate + 0.5) / (all1 + 2)) - np.log((n0 + rate + 0.5) / (all0 + 2)))


class Index:
    """Block-max inverted index of the examples' unit vectors; examples are (id, label, features, counts)."""

    BLOCK = 64

    def __init__(self, weight: np.ndarray, examples: list[tuple], k: int):
        self.weight, self.k = weight, k
        filled = [e for e in examples if len(e[2])]
        # alike examples share blocks, which keeps bounds tight: by class, then by the features of most weight
        heavy = [(e[1], *np.asarray(e[2])[np.argsort(-self.unit(e[2], e[3]), kind="stable")[:3]].tolist(), e[0]) for e in filled]
        filled = [filled[i] for i in sorted(range(len(filled)), key=heavy.__getitem__)]
        self.ids = np.array([e[0] for e in filled], np.int64)
        self.label = np.array([e[1] for e in filled], np.float64)
        self.same: dict[bytes, list[int]] = {}
        for at, e in enumerate(filled):
            self.same.setdefault(self._key(e[2], e[3]), []).append(at)
        self.blocks = -(-len(filled) // self.BLOCK)
        feature = np.concatenate([np.zeros(0, np.int32), *(np.asarray(e[2], np.int32) for e in filled)])
        owner = np.repeat(np.arange(len(filled), dtype=np.int32), [len(e[2]) for e in filled])
        value = np.concatenate([np.zeros(0), *(self.unit(e[2], e[3]) for e in filled)])
        self.rows = np.r_[0, np.cumsum([len(e[2]) for e in filled])].astype(np.int64)
        self.row_feature, self.row_value, self.read = feature, value, 0
        order = np.lexsort((owner, feature))
        feature, self.owner, self.value = feature[order], owner[order], value[order]
        # postings of feature f stand from start[f] to start[f + 1]; the blocks that it stands in, from block_start[f], with its largest weight in each
        self.start = np.searchsorted(feature, np.arange(len(weight) + 1)).astype(np.int64)
        block = self.owner // self.BLOCK
        first = np.flatnonzero(np.r_[True, (feature[1:] != feature[:-1]) | (block[1:] != block[:-1])][: len(feature)])
        self.block_start = np.searchsorted(feature[first], np.arange(len(weight) + 1)).astype(np.int64)
        self.block_of = block[first]
        self.block_most = np.maximum.reduceat(self.value, first) if len(first) else self.value
        self.most = np.zeros(len(weight))
        np.maximum.at(self.most, feature[first], self.block_most)
        self.query = np.zeros(len(weight))  # zero between searches

    @staticmethod
    def _key(fids, tfs) -> bytes:
        return np.asarray([fids, tfs], np.int32).tobytes()

    def unit(self, fids, tfs) -> np.ndarray:
        w = (1 + np.log(np.asarray(tfs, np.float64))) * self.weight[np.asarray(fids, int)]
        length = np.linalg.norm(w)
        return w / length if length else w

    def _sums(self, fids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of all examples, over the postings of these features."""
        start = self.start[fids]
        n = self.start[fids + 1] - start
        at = _places(start, n)
        self.read += len(at)
        return np.bincount(self.owner[at], self.value[at] * np.repeat(w, n), len(self.ids))

    def _bounds(self, fids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What these features can add to each example, by the maxima of its block."""
        start = self.block_start[fids]
        n = self.block_start[fids + 1] - start
        at = _places(start, n)
        return np.repeat(np.bincount(self.block_of[at], self.block_most[at] * np.repeat(w, n), self.blocks), self.BLOCK)[: len(self.ids)]

    def _whole(self, fids: np.ndarray, w: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Cosines of some examples by their own vectors."""
        self.query[fids] = w
        start = self.rows[places]
        n = self.rows[places + 1] - start
        at = _places(start, n)
        found = np.bincount(np.repeat(np.arange(len(places)), n), self.query[self.row_feature[at]] * self.row_value[at], len(places))
        self.query[fids] = 0.0
        return found

    def nearest(self, fids, tfs, loose: float = 0.01, many: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k nearest examples with a positive cosine and other counts than these, and their cosines."""
        none = np.zeros(0, int), np.zeros(0)
        if not len(fids) or not len(self.ids):
            return none
        w, at = self.unit(fids, tfs), np.asarray(fids, int)
        own = self.same.get(self._key(fids, tfs), [])
        most = w * self.most[at]
        order = np.argsort(-most, kind="stable")
        left = most.sum() - np.cumsum(most[order])
        cut = int(np.searchsorted(-left, -loose)) + 1  # features read; the others can add ``loose`` at most
        read, rest = order[:cut], order[cut:]
        sums = self._sums(at[read], w[read])
        sums[own] = -np.inf
        k = min(self.k, len(sums))
        least = max(np.partition(sums, len(sums) - k)[len(sums) - k], 0.0)
        reach = sums + self._bounds(at[rest], w[rest]) if len(rest) else sums
        places = np.flatnonzero((reach >= least - 1e-9) & (reach > 0))
        if len(places) > many and len(rest):
            cosines = (sums + self._sums(at[rest], w[rest]))[places]
        else:
            cosines = self._whole(at, w, places)
        places, cosines = places[cosines > 0], cosines[cosines > 0]
        best = np.lexsort((self.ids[places], -cosines))[: self.k]
        return places[best], cosines[best]


class Model:
    """Scores of feature counts: votes of the nearest examples, calibrated."""

    def __init__(self, weight: np.ndarray, examples, totals: dict[int, int], k: int, pull: float):
        # an example stands for so many labels of its class
        stands = {y: totals.get(y, 0) / max(1, sum(e[1] == y for e in examples)) for y in (0, 1)}
        blank = {y: stands[y] * sum(e[1] == y and not len(e[2]) for e in examples) for y in (0, 1)}
        self.base = blank[1] / (blank[0] + blank[1]) if blank[0] + blank[1] else totals.get(1, 0) / max(1, sum(totals.values()))
        mean = sum(totals.values()) / max(1, len(examples))
        self.votes = np.array([stands[0], stands[1]]) / (mean or 1.0)
        self.pull, self.index = pull, Index(weight, examples, k)
        self.curve = (0.0, 1.0)
        self.curve = self.fit([e for e in examples if len(e[2])], stands)

    def share(self, fids, tfs) -> tuple[float | None, list[int]]:
        """Weighted share of votes for label 1 and the nearest examples; None without any."""
        places, cos = self.index.nearest(fids, tfs)
        if not len(places):
            return None, []
        label = self.index.label[places]
        votes = cos * self.votes[label.astype(int)]
        return float((votes @ label + self.pull * self.base) / (votes.sum() + self.pull)), self.index.ids[places[:3]].tolist()

    def fit(self, examples, stands: dict[int, float]) -> tuple[float, float]:
        """Offset and slope of the logistic curve over the log odds of the share; none with examples of one class only."""
        got = [(odds(s), y) for _, y, fids, tfs in examples if (s := self.share(fids, tfs)[0]) is not None]
        x, y = (np.array([g[i] for g in got], np.float64) for i in (0, 1))
        return logistic(x, y, np.where(y == 1, stands[1], stands[0]))

    def score(self, fids, tfs) -> tuple[float, list[int]]:
        share, evidence = self.share(fids, tfs)
        if share is None:
            return self.base, []
        return sigmoid(self.curve[0] + self.curve[1] * odds(share)), evidence


def sigmoid(x: float) -> float:
    """A steep curve may leave the range of exponents; the limits are 0 and 1."""
    return 1 / (1 + math.exp(-min(max(x, -700.0), 700.0)))


def odds(share: float) -> float:
    """Log odds, held within the range of one in a million."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Weighted logistic fit by damped Newton steps, with labels drawn in a little so that the slope stays finite."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        return 0.0, 1.0
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([np.ones_like(x), x])
    beta = np.array([0.0, 1.0])
    loss = lambda b: float(weight @ (np.logaddexp(0, b @ z) - t * (b @ z)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(beta @ z)))
        gradient = z @ (weight * (p - t))
        curvature = (z * (weight * p * (1 - p))) @ z.T + 1e-9 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-10:
            break
        beta = beta - size * step
    return (float(beta[0]), float(beta[1])) if beta[1] > 0 else (0.0, 1.0)


def _examples(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic, text of at most per_class rows a label, and how many there are of each."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi")
    known = materialize(known, "labels", tasks_for(labels))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.filter("toxic = 0").orderBy(*order).limit(per_class).union(known.filter("toxic = 1").orderBy(*order).limit(per_class))
    # 2 * per_class rows of two numbers: a proven bound
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(texts, "examples", files_for(2 * per_class)), totals


def _features(examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """All features of the examples and the size of their class difference; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(features_of(text).keys())
        keys = list(seen[0].keys() | seen[1].keys())
        for s in range(0, len(keys), 1 << 16):
            part = keys[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in seen)], names=["f", "n0", "n1"])

    n0, n1 = examples.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    counted = examples.select("toxic", "text").mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = sorted(tuple(r) for r in counted.collect())  # of 2 * per_class texts
    return [r[0] for r in rows], class_difference(*(np.array([r[i] for r in rows], np.float64) for i in (1, 2)), n0, n1)


def _some(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP_BYTES of text; a longer text stands alone."""
    size = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + STEP_BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """A view of each row's numbers."""
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), ends[1:-1] - ends[0]) if len(column) else []


def _vectors(docs: DataFrame, features: list[str], extra: list[str]) -> DataFrame:
    """The extra columns, and the numbers and counts of the features in each text."""
    names = [*extra, "fids", "tfs"]
    # a text that is carried goes to Python once
    sent = extra if "text" in extra else [*extra, "text"]
    at = sent.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(features, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in _some(batch, at):
                offsets, fids, tfs = numbered(part.column(at).to_pylist(), known)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (fids, tfs)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(extra)], *lists], names=names)
            # no batch stands beside the next one
            batch = part = None
            give_back()

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(*sent).mapInArrow(run, f"{kinds}, fids array<int>, tfs array<int>")


def _document_frequencies(vectors: DataFrame) -> dict[int, int]:
    """In how many texts each feature stands: a task passes on one row for each feature, however common it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.asarray(batch.column(0).flatten()), minlength=len(seen))
            own[: len(seen)] += seen
            seen = own
        f = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(seen[f], pa.int64())], names=["f", "n"])

    found = vectors.select("fids").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    return {r["f"]: r["n"] for r in found.collect()}  # features of 2 * per_class texts


def score(docs: DataFrame, labels: DataFrame, per_class: int = 1000, k: int = 15, pull: float = 0.1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and as evidence the ids of the nearest examples, and the columns named in ``carry``."""
    examples, totals = _examples(docs, labels, per_class)
    features, difference = _features(examples)
    vectors = materialize(_vectors(docs, features, ["doc_id", *carry]), "vectors")
    n = vectors.count()
    df = _document_frequencies(vectors)
    idf = np.array([math.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(len(features))])
    made = _vectors(examples, features, ["doc_id", "toxic"]).toArrow().combine_chunks()  # 2 * per_class rows at most
    ids, toxic, fids, tfs = (made.column(i).combine_chunks() for i in range(4))
    rows = sorted(zip(ids.to_pylist(), toxic.to_pylist(), _lists(fids), _lists(tfs)), key=lambda r: r[:2])
    model = Model(idf * difference, rows, totals, k, pull)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_own = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        give_back()  # of what the model was read from
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                found = [own.score(f, t) for f, t in zip(_lists(part.column(n_own)), _lists(part.column(n_own + 1)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_own], pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["doc_id", *carry, "score", "evidence"])
            batch = part = None
            give_back()

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    out = vectors.mapInArrow(run, f"{kinds}, score double, evidence array<bigint>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", *carry)
