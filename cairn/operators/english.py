"""English word stems by the published suffix rules of the second Porter algorithm, and an encoder with them.

Tokens are lower-cased words without stop words and without very long ones. Stems are made
in Arrow batches: a batch's tokens are first turned into a dictionary, and each distinct word
is stemmed once; a task remembers the words that it has seen, up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexical

#: Words that carry no meaning of their own, and how long a token may be.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now d ll m o re ve y""".split()
)
MOST_CHARS = 40
#: The constant that stands for the mean length of a text, in tokens.
AVERAGE_LENGTH = 256
REMEMBERED = 1 << 18

#: Fixed values of the published rules: suffixes, longest first, and what stands for them.
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion",
    "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al",
    "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
ENDS_2, ENDS_3 = tuple(STEP_2), tuple(STEP_3)
BEFORE_LI = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_STARTS = ("gener", "commun", "arsen")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _suffix(word: str, suffixes: tuple[str, ...]) -> str:
    """The longest of the suffixes at the end of the word; most words have none."""
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else ""


def _mark_consonants(word: str) -> str:
    """Each y that begins a word or follows a vowel becomes Y, which is no vowel."""
    if "y" not in word:
        return word
    out = ""
    for c in word:
        out += "Y" if c == "y" and (not out or out[-1] in "aeiouy") else c
    return out


def stem(word: str) -> str:
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if len(word) <= 2:
        return word
    word = _mark_consonants(word.removeprefix("'"))
    start = next((len(s) for s in LONG_STARTS if word.startswith(s)), None)
    if start is None:
        found = _REGION.search(word)
        start = found.end() if found else len(word)
    found = _REGION.search(word, start)
    first, second = start, found.end() if found else len(word)
    word = word.removesuffix(_suffix(word, ("'s'", "'s", "'")))

    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in UNCHANGED_AFTER_PLURAL:
        return word

    # past and present participles
    end = _suffix(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= first:
            word = word[: -len(end)] + "ee"
    elif end and _VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= first and _SHORT_END.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _suffix(word, ENDS_2)
    if end and len(word) - len(end) >= first:
        before = word[-len(end) - 1 : -len(end)]
        if not (end == "li" and before not in BEFORE_LI) and not (end == "ogi" and before != "l"):
            word = word[: -len(end)] + STEP_2[end]

    end = _suffix(word, ENDS_3)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + STEP_3[end]

    end = _suffix(word, STEP_4)
    if end and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]

    if word.endswith("e"):
        if len(word) > second or len(word) > first and not _SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > second:
        word = word[:-1]
    return word.replace("Y", "y")


def _stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Lists of stems of lists of tokens; stop words and very long ones are dropped where each distinct token is looked at once."""
    known: dict[str, str | None] = {}
    for lists in batches:
        words = lists.flatten().dictionary_encode()
        if len(known) > REMEMBERED:
            known.clear()
        made = []
        for w in words.dictionary.to_pylist():
            if w not in known:
                known[w] = None if w in STOP_WORDS or len(w) > MOST_CHARS else stem(w)
            made.append(known[w])
        stems = pa.array(made, pa.string())
        held = stems.is_valid().take(words.indices)
        ends = np.r_[0, np.cumsum(np.asarray(held))][np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems.take(words.indices.filter(held)))


def _kept(tokens):
    return F.filter(tokens, lambda t: ~t.isin(*sorted(STOP_WORDS)) & (F.length(t) <= MOST_CHARS))


def encode(rows: DataFrame) -> DataFrame:
    """The rows with ``tokens``, an array of stems of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (made,) = _stems(iter([b.column(b.num_columns - 1)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=b.schema.names)

    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, lexical.tokens(F.col("text")).alias("tokens")).mapInArrow(run, f"{kinds}, tokens array<string>")


def dictionary(docs: DataFrame) -> DataFrame:
    """term, stem of each distinct term of the texts."""
    terms = docs.select(F.explode(F.array_distinct(_kept(lexical.tokens(F.col("text"))))).alias("term")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem(t) for t in b.column(0).to_pylist()], pa.string())], names=["term", "stem"])

    return terms.mapInArrow(run, "term string, stem string")
