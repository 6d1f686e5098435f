"""Band tokens: numbers with a direction as terms that a lexical index can match."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, MOST = 500, 5000

#: Fixed values, most specific first: pattern, and the range of a match (lo and hi are its numbers).
PATTERNS = (
    (r"(?U)\b(\d{1,5})\s*%?\s*[-–]\s*(\d{1,5})\s*%", lambda lo, hi: (lo, hi)),
    (r"(?U)\b(\d{1,5})\s*%\s*\+", lambda lo, hi: (lo, F.lit(MOST))),
    (r"(?iU)(?:below|under|<)\s*(\d{1,5})\s*%", lambda lo, hi: (F.lit(0), F.greatest(lo - STEP, F.lit(0)))),
    (r"(?iU)(?:above|over)\s*(\d{1,5})\s*%", lambda lo, hi: (lo, F.lit(MOST))),
    (r"(?iU)\b(\d{1,5})\s*%\s*(?=\w*\s*enrage)", lambda lo, hi: (lo, lo)),
)


def _ladder(lo: Column, hi: Column) -> Column:
    lo, hi = (F.greatest(F.lit(0), F.least(x, F.lit(MOST))) for x in (lo, hi))
    return F.sequence((F.floor(lo / STEP) * STEP).cast("int"), hi.cast("int"), F.lit(STEP))


#: Decimal digits of every script, and the ASCII digits of their values.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def _number(digits: Column) -> Column:
    """The patterns take digits of any script."""
    return F.translate(digits, "".join(_DIGITS), _VALUES).try_cast("int")


def _bands_of(span):
    def bands(a: Column, b: Column) -> Column:
        a, b = _number(a), _number(b)
        # an inverted range is consumed and gives nothing
        return F.when(a <= b, _ladder(*span(a, b))).otherwise(F.array().cast("array<int>"))

    return bands


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def band_tokens(text: Column) -> Column:
    """Tokens of all expressions in the text, each once, in order of the patterns; a match is blanked for those after it."""

    def bands(rest: Column, patterns) -> Column:
        (pattern, span), *others = patterns
        lows = F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))
        highs = F.regexp_extract_all(rest, F.lit(pattern), F.lit(2)) if pattern.count("(\\d") == 2 else lows
        found = F.flatten(F.zip_with(lows, highs, _bands_of(span)))
        # each text with blanks is made once
        return F.concat(found, let(F.regexp_replace(rest, pattern, " "), lambda x: bands(x, others))) if others else found

    tokens = F.transform(F.array_distinct(bands(text, PATTERNS)), lambda b: F.concat(F.lit("enrageband"), b.cast("string")))
    return F.when(text.contains("%"), tokens).otherwise(F.array().cast("array<string>"))


def _with_tokens(text: Column, form: tuple[str, str]) -> Column:
    return let(band_tokens(text), lambda tokens: F.when(F.size(tokens) > 0, F.concat(text, F.lit(form[0]), F.array_join(tokens, " "), F.lit(form[1]))).otherwise(text))


def annotate(text: Column) -> Column:
    """Each line with its tokens in brackets behind it."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: _with_tokens(x, (" [", "]")))
    return F.when(text.contains("%"), F.array_join(lines, "\n")).otherwise(text)


def annotate_query(text: Column) -> Column:
    return _with_tokens(text, (" ", ""))


def strip_tokens(text: Column) -> Column:
    """Without bracketed tokens and the white space before them; nothing is tried twice, so long runs cost their length only."""
    return F.regexp_replace(text, r"(?<!\s)\s*+\[(?>enrageband\d+\s*+)++\]", "")
