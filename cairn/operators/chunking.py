"""Sections by header and chunks by size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import let
from ..functions.clean import SPACES, strip

SEPARATORS = ("\n\n", "\n", " ", "")
LEVELS = 3
SHORT = 1 << 20
"""Characters of a text in which places are looked up; longer ones go piece by piece, to the same end."""


def section_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, line, section_no, h1, h2, h3 of each line: headers are filled down, a higher one resets those below it.

    A document's lines stay in its row until all is known of its headers: no exchange. A fold goes over headers only.
    """
    lines = docs.select(key, F.split("text", "\n", -1).alias("lines"))
    title = lambda x: F.trim(F.regexp_replace(x, r"^#{1,3}", ""))
    marked = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_extract(x, r"^(#{1,3})(?: |$)", 1)).alias("level"), x.alias("line")))
    heads = F.filter(marked, lambda x: x["level"] > 0)
    kind = "struct<at:int,h1:string,h2:string,h3:string>"
    begin = F.array(F.struct(F.lit(0).alias("at"), *(F.lit(None).cast("string").alias(h) for h in ("h1", "h2", "h3"))).cast(kind))

    def add(done: Column, x: Column) -> Column:
        above, level, own = F.element_at(done, -1), x["level"], title(x["line"])
        h = [F.when(level == n, own).when(level > n, above[f"h{n}"]).alias(f"h{n}") for n in (1, 2, 3)]
        return F.concat(done, F.array(F.struct(x["at"].alias("at"), *h)))

    parts = lines.select(key, "lines", F.aggregate(heads, begin, add).alias("s"))
    # each section brings its own lines: from its header to the next one
    stop = lambda i: F.coalesce(F.get(F.col("s"), i + 1)["at"], F.size("lines"))
    cut = F.transform("s", lambda x, i: F.struct(x["at"].alias("at"), x["h1"].alias("h1"), x["h2"].alias("h2"), x["h3"].alias("h3"), F.slice("lines", x["at"] + 1, stop(i) - x["at"]).alias("own")))
    out = parts.select(key, F.posexplode(cut).alias("section_no", "s")).select(key, "section_no", "s", F.posexplode("s.own").alias("nth", "line"))
    return out.select(key, (F.col("s.at") + F.col("nth")).cast("long").alias("line_no"), "line", F.col("section_no").cast("long").alias("section_no"), "s.h1", "s.h2", "s.h3")


#: What does not print, but for the space.
HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"
_HEADS = tuple(f"h{n}" for n in range(1, LEVELS + 1))
_HEAD = "struct<at:int," + ",".join(f"{h}:string" for h in _HEADS) + ">"


def _headers(lines: Column) -> Column:
    """(at, h1, h2, h3) of each header line outside code fences, after one at 0 for what stands before: a fold over lines that begin with a mark only."""
    level = lambda x: F.length(F.regexp_extract(x, rf"^(#{{1,{LEVELS}}})(?: |$)", 1))
    marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda m: m["line"].rlike("^(?:#|```|~~~)"))
    no_head = F.struct(F.lit(0).alias("at"), *(F.lit(None).cast("string").alias(h) for h in _HEADS)).cast(_HEAD)
    begin = F.struct(F.lit("").alias("fence"), F.array(no_head).alias("heads"))

    def step(s: Column, m: Column) -> Column:
        line, fence = m["line"], F.substring(m["line"], 1, 3)
        opens = (s["fence"] == "") & fence.isin("```", "~~~") & ~F.contains(F.substring(line, F.lit(4), F.length(line)), fence)
        now = F.when(opens, fence).when((s["fence"] != "") & line.startswith(s["fence"]), "").otherwise(s["fence"])

        def head(above: Column) -> Column:
            own = lambda n: F.when(level(line) == n, strip(F.substring(line, F.lit(n + 1), F.length(line)))).when(level(line) > n, above[f"h{n}"])
            return F.struct(m["at"].alias("at"), *(own(n).alias(h) for n, h in enumerate(_HEADS, 1)))

        heads = F.when((now == "") & (level(line) > 0), F.concat(s["heads"], F.array(head(F.element_at(s["heads"], -1))))).otherwise(s["heads"])
        return F.struct(now.alias("fence"), heads.alias("heads"))

    return F.aggregate(marked, begin, step, lambda s: s["heads"])


def _blocks(lines: Column) -> Column:
    """Stretches of lines without an empty one between."""
    filled = lambda i: F.get(lines, i) != ""
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: filled(i) & ((i == 0) | ~F.coalesce(filled(i - 1), F.lit(False))))
    cut = lambda s: F.transform(s, lambda i, n: F.slice(lines, i + 1, F.coalesce(F.get(s, n + 1), F.size(lines)) - i))
    return F.transform(let(starts, cut), lambda b: F.array_join(F.filter(b, lambda x: x != ""), "\n"))


def header_sections(text: Column) -> Column:
    """array(struct(text, h1, h2, h3)): lines stripped, code fences hide headers, empty lines end blocks.

    Blocks with equal headers are joined; a section that ends in a header line joins the deeper one after it. Whether
    two neighbours are joined is seen from the two alone.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(strip(x), HIDDEN, ""))

    def regions(found: Column) -> Column:
        """What stands under each header, in blocks."""

        def cut(heads: Column) -> Column:
            stop = lambda i: F.coalesce(F.get(heads, i + 1)["at"], F.size(found))
            own = lambda h, i: F.slice(found, h["at"] + 1, stop(i) - h["at"])
            of = lambda h, i: let(F.filter(own(h, i), lambda x: x != ""), lambda filled: F.struct(
                F.array_join(_blocks(own(h, i)), "  \n").alias("text"), F.coalesce(F.get(filled, F.size(filled) - 1).startswith("#"), F.lit(False)).alias("hangs"), *(h[x].alias(x) for x in _HEADS)))
            return F.filter(F.transform(heads, of), lambda r: r["text"] != "")

        return let(_headers(found), cut)

    depth = lambda r: sum((r[h].isNotNull().cast("int") for h in _HEADS[1:]), r[_HEADS[0]].isNotNull().cast("int"))

    def joined(found: Column) -> Column:
        def begins(i: Column) -> Column:
            one, two = F.get(found, i - 1), F.get(found, i)
            same = reduce(lambda x, y: x & y, (one[h].eqNullSafe(two[h]) for h in _HEADS))
            return (i == 0) | ~(same | ((depth(one) < depth(two)) & one["hangs"]))

        starts = F.when(F.size(found) > 0, F.filter(F.sequence(F.lit(0), F.size(found) - 1), begins)).otherwise(F.array().cast("array<int>"))

        def cut(s: Column) -> Column:
            end = lambda n: F.coalesce(F.get(s, n + 1), F.size(found))
            text = lambda i, n: F.array_join(F.transform(F.slice(found, i + 1, end(n) - i), lambda r: r["text"]), "  \n")
            return F.transform(s, lambda i, n: F.struct(text(i, n).alias("text"), *(F.get(found, end(n) - 1)[h].alias(h) for h in _HEADS)))

        return let(starts, cut)

    return let(lines, lambda x: let(regions(x), joined))


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section_no, text, h1, h2, h3; a document stays in its row until it is cut."""
    out = docs.select(key, F.posexplode(header_sections(F.col("text"))).alias("section_no", "s"))
    return out.select(key, F.col("section_no").cast("long").alias("section_no"), "s.text", *(f"s.{h}" for h in _HEADS))


# The chunker is SQL text: as Columns its plan would take seconds to put together, a call for each of some hundred nodes.
# Each piece of text stands in lambdas of its own; ``_bind`` names a value that is computed once.

_STRINGS = "cast(array() AS array<string>)"


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"


def _put(out: str, text: str) -> str:
    """The array with the text behind it, stripped, unless nothing is left."""
    return _bind(f"btrim({text}, {_literal(SPACES)})", "stripped", f"CASE WHEN stripped <> '' THEN concat({out}, array(stripped)) ELSE {out} END")


def _windows(pieces: str, size: int, overlap: int) -> str:
    """Pieces joined greedily up to ``size`` characters; a window begins with the last pieces of the one before, up to ``overlap`` characters and as far as the next piece leaves room."""
    # the window's own pieces are carried along: a slice of all pieces costs as much as all of them
    put = _put("s.out", "array_join(s.win, '')")
    # how many of the last pieces of the window stay
    fits = f"k.open AND k.sum + length(w) <= least({overlap}, {size} - length(piece))"
    kept = f"""aggregate(reverse(s.win), named_struct('n', 0, 'sum', 0, 'open', true),
      (k, w) -> named_struct('n', k.n + CASE WHEN {fits} THEN 1 ELSE 0 END, 'sum', k.sum + CASE WHEN {fits} THEN length(w) ELSE 0 END, 'open', {fits}))"""
    after = f"named_struct('win', concat(slice(s.win, size(s.win) - k.n + 1, k.n), array(piece)), 'len', k.sum + length(piece), 'out', {put})"
    more = "named_struct('win', concat(s.win, array(piece)), 'len', s.len + length(piece), 'out', s.out)"
    step = f"CASE WHEN size(s.win) > 0 AND s.len + length(piece) > {size} THEN {_bind(kept, 'k', after)} ELSE {more} END"
    return f"""aggregate({pieces}, named_struct('win', {_STRINGS}, 'len', 0, 'out', {_STRINGS}), (s, piece) -> {step}, s -> {put})"""


def _windows_at(text: str, mark: str, size: int, overlap: int) -> str:
    """The same of a text without large pieces, by places: a step for each window instead of each piece.

    A window ends at the last mark within ``size`` characters; the next one begins at the first mark within what it may repeat.
    Every two windows are more than size - overlap characters apart, which bounds their number.
    """
    begins = f"instr(substring({text}, e - m + 1, m), {mark})"
    after = f"named_struct('at', CASE WHEN m > 0 AND {begins} > 0 THEN e - m + {begins} - 1 ELSE e END, 'done', false, 'out', {_put('s.out', f'substring({text}, s.at + 1, e - s.at)')})"
    ahead = f"instr(substring({text}, e + 2, {size}), {mark})"
    room = f"least({overlap}, {size} - CASE WHEN {ahead} > 0 THEN {ahead} ELSE length({text}) - e END)"
    end = f"s.at + {size + 1} - instr(reverse(substring({text}, s.at + 1, {size + 1})), {mark})"
    last = f"named_struct('at', s.at, 'done', true, 'out', {_put('s.out', f'substring({text}, s.at + 1)')})"
    step = f"CASE WHEN s.done THEN s WHEN length({text}) - s.at <= {size} THEN {last} ELSE {_bind(end, 'e', _bind(room, 'm', after))} END"
    times = f"array_repeat(0, cast(2 * ceil(length({text}) / {size - overlap}) + 2 AS int))"
    return f"aggregate({times}, named_struct('at', 0, 'done', false, 'out', {_STRINGS}), (s, i) -> {step}, s -> s.out)"


def _characters(text: str, size: int, overlap: int) -> str:
    """Windows of single characters: they begin every size - overlap."""
    step = size - overlap
    last = f"cast(greatest(ceil((length({text}) - {size}) / {step}), 0) AS int)"
    return f"filter(transform(sequence(0, {last}), i -> btrim(substring({text}, i * {step} + 1, {size}), {_literal(SPACES)})), t -> t <> '')"


def recursive_chunks(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, depth: int = 0) -> str:
    """SQL for the chunks of a text: pieces of at most ``size`` characters, cut at the coarsest separator that helps, each beginning with up to ``overlap`` of what came before.

    A separator stays with what follows it. Pieces of ``size`` and more are cut by the next separator, on their own;
    those between are joined to windows.
    """
    mark, *finer = separators
    if not mark:
        return _characters(text, size, overlap)
    sign, p, s, run = _literal(mark), f"p{depth}", f"s{depth}", f"run{depth}"
    cut = f"filter(transform(split({text}, {sign}, -1), (x, i) -> CASE WHEN i = 0 THEN x ELSE concat({sign}, x) END), x -> x <> '')"
    large = lambda x: f"length({x}) >= {size}"
    starts = f"filter(sequence(0, size({p}) - 1), i -> i = 0 OR {large(f'{p}[i]')} OR {large(f'{p}[i - 1]')})"
    each = f"CASE WHEN {large(f'{run}[0]')} THEN {_bind(f'{run}[0]', f'large{depth}', recursive_chunks(f'large{depth}', size, overlap, tuple(finer), depth + 1))} ELSE {_windows(run, size, overlap)} END"
    runs = f"flatten(transform({s}, (at, n) -> {_bind(f'slice({p}, at + 1, coalesce(get({s}, n + 1), size({p})) - at)', run, each)}))"
    whole = _bind(cut, p, f"CASE WHEN size({p}) > 0 THEN {_bind(starts, s, runs)} ELSE {_STRINGS} END")
    if len(mark) > 1:
        return whole
    # no piece can be large, and looking up a place in the text is cheap; a stretch is looked at from its beginning only
    plain = f"length({text}) <= {SHORT} AND NOT {text} RLIKE {_literal(f'(?:^|{mark})[^{mark}]{{{max(1, size - 1)}}}')}"
    return f"CASE WHEN {plain} THEN {_windows_at(text, sign, size, overlap)} ELSE {whole} END"


def chunk_recursive(docs: DataFrame, key: str = "doc_id", size: int = 500, overlap: int = 50) -> DataFrame:
    """The rows with a chunk each in ``text``, and its number."""
    others = [c for c in docs.columns if c not in ("text", "chunk_no")]
    # most texts need no cut at all
    short = f"length(text) < {size} THEN {_put(_STRINGS, 'text')}"
    chunks = F.expr(f"CASE WHEN text IS NULL THEN {_STRINGS} WHEN {short} ELSE {recursive_chunks('text', size, overlap)} END")
    out = docs.select(*others, F.posexplode(chunks).alias("chunk_no", "text"))
    return out.withColumn("chunk_no", F.col("chunk_no").cast("long"))


def chunk_fixed(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` characters that begin every size - overlap; all on the JVM side."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)).cast("int") - 1
    others = [c for c in docs.columns if c not in ("text", "chunk_no")]
    out = docs.select(*others, "text", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_no"))
    start = (F.col("chunk_no") * step + 1).cast("int")
    return out.withColumn("text", F.substring(F.col("text"), start, F.lit(size)))


def with_metadata(chunks: DataFrame, name: Column, style: Column, boss: Column) -> DataFrame:
    return chunks.withColumns({"source": name, "style": style, "boss": boss})
