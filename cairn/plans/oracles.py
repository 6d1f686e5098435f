"""The catalogue's queries as DuckDB SQL, written independently of the Spark operators."""

from __future__ import annotations

import re

from ..functions.lookup import NAMES, REFUSALS, rendered
from . import catalogue as c

NL = "chr(10)"
q = lambda s: "'" + s.replace("'", "''") + "'"

MARKED = f"SELECT doc_id, {c.MARKED} AS text FROM documents"


def sub(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {by}, 'g')"


def d_collapse(t: str) -> str:
    for name in sorted(set(NAMES.values()), key=lambda n: (-len(n), n)):
        e = re.sub(r"([^\w ])", r"\\\1", name)
        t = sub(t, f"(?:{e} )+{e}", q(name))
    return t


def d_expand(t: str) -> str:
    for code, name in rendered("both").items():
        t = sub(t, f"<:{code}:\\d+>", q(name))
    return d_collapse(sub(t, r"<:([a-zA-Z0-9_]+):\d+>", r"'\1'"))


def d_strip(t: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({t}, {NL}), lambda x: NOT starts_with(x, '.')), lambda x: regexp_replace(x, '<[#@!]+\\d+>', '', 'g')), {NL})"


def d_bullets(t: str) -> str:
    return f"translate({t}, '⬥⬩•', '---')"


def d_blank(t: str) -> str:
    return f"{sub(sub(t, chr(92) + 'n{3,}', NL + ' || ' + NL), '^' + chr(92) + 's+|' + chr(92) + 's+$', q(''))} || {NL}"


def d_clean(t: str) -> str:
    return d_blank(d_bullets(d_strip(d_expand(t))))


def digest(inner: str, expr: str) -> str:
    return f"SELECT doc_id, length(x)::BIGINT AS chars, md5(x) AS digest FROM (SELECT doc_id, {expr} AS x FROM ({inner}))"


#: Fixed values, as in the band functions: here in RE2's dialect, which has no look-ahead.
_P = (
    r"\b(\d{1,5})\s*%?\s*[-–]\s*(\d{1,5})\s*%",
    r"\b(\d{1,5})\s*%\s*\+",
    r"(?i)(?:below|under|<)\s*(\d{1,5})\s*%",
    r"(?i)(?:above|over)\s*(\d{1,5})\s*%",
    r"(?i)\b(\d{1,5})\s*%\s*\w*\s*enrage",
)


BAND_LINES = f"SELECT o_orderkey, {c.BAND_LINE} AS line FROM orders"


def d_bands(inner: str = BAND_LINES, key: str = "o_orderkey") -> str:
    """The key, line, tokens."""
    series = lambda lo, hi: f"generate_series((least(greatest({lo}, 0), 5000) // 500) * 500, least(greatest({hi}, 0), 5000), 500)"
    one = lambda n, lo, hi: f"flatten(list_transform(a{n}, lambda z: {series(lo, hi)}))"
    v = "z::BIGINT"
    inner = f"SELECT *, regexp_extract_all(line, {q(_P[0])}, 1) AS a0, regexp_extract_all(line, {q(_P[0])}, 2) AS b0, {sub('line', _P[0], q(' '))} AS r0 FROM ({inner})"
    for n in range(1, 5):
        inner = f"SELECT *, regexp_extract_all(r{n - 1}, {q(_P[n])}, 1) AS a{n}, {sub(f'r{n - 1}', _P[n], q(' '))} AS r{n} FROM ({inner})"
    first = f"flatten(list_transform(list_zip(a0, b0), lambda z: CASE WHEN z[1]::BIGINT <= z[2]::BIGINT THEN {series('z[1]::BIGINT', 'z[2]::BIGINT')} ELSE [] END))"
    every = f"flatten([{first}, {one(1, v, '5000')}, {one(2, '0', f'greatest({v} - 500, 0)')}, {one(3, v, '5000')}, {one(4, v, v)}])"
    return f"""SELECT {key}, line, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: 'enrageband' || x), ' ') AS tokens
FROM (SELECT {key}, line, {every} AS l FROM ({inner}))"""


TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\p{L}\p{N}_]+'), lambda t: t <> '')"
tokens = lambda t: TOKENS.replace("{t}", t)

INDEX = f"""dl AS (SELECT doc_id, {tokens('text')} AS t FROM documents __WHERE__),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM dl),
tf AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dl) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st)"""
QUESTIONS = """qs AS (SELECT item_id AS qid, text, text AS phrase, length(text) % 3 AS k FROM benchmark)"""


def weight(b: float) -> str:
    return f"tf * (1.2 + 1) / (tf + 1.2 * (1 - {b} + {b} * len / avg_len))"


def d_search(name: str, b: float, k: int = 10) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT qid, doc_id, list_reduce(list_sort(list(idf * {weight(b)})), lambda x, y: x + y) AS score FROM (SELECT DISTINCT qid, unnest({tokens('text')}) AS term FROM qs) JOIN tf USING (term) JOIN idf USING (term), st GROUP BY qid, doc_id)) WHERE rank <= {k})"""


SEARCH = "WITH " + INDEX.replace("__WHERE__", "") + ", " + QUESTIONS
QRELS = """rel AS (SELECT qid, doc_id, 1 AS grade FROM qs JOIN documents d ON contains(d.text, phrase) AND contains(lower(d.source), 'src')
  AND (qid % 2 = 0 OR list_contains(list_transform(range(10), lambda i: 'src' || i), d.source)) WHERE phrase <> '')"""
RUNS = f"""{SEARCH}, {d_search('ra', 0.75)}, {d_search('rb', 0.0)}, {QRELS},
runs AS (SELECT 'base' AS collection, * FROM ra UNION ALL SELECT 'flat', * FROM rb),
asked AS (SELECT DISTINCT qid, collection FROM rel, (SELECT unnest(['base', 'flat']) AS collection)),
rr AS (SELECT a.collection, a.qid, min(rank) AS first_rank, coalesce(1 / min(rank), 0.0) AS rr
  FROM asked a LEFT JOIN (SELECT runs.* FROM runs SEMI JOIN rel ON runs.qid = rel.qid AND runs.doc_id = rel.doc_id) r ON a.qid = r.qid AND a.collection = r.collection GROUP BY a.collection, a.qid)"""
_rate = lambda k: f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6)"
RATES = "SELECT collection, " + ", ".join(f"{_rate(k)} AS hit_rate_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(rr), 6) AS mrr_at_10, count(*) AS questions FROM rr GROUP BY collection"

COMPARED = f"""{RUNS}, top AS (SELECT collection, qid, max(score) AS top FROM runs GROUP BY ALL),
f AS (SELECT qs.qid, c.collection, rr.first_rank, coalesce(top.top, 0.0) AS top FROM qs CROSS JOIN (SELECT unnest(['base', 'flat']) AS collection) c LEFT JOIN rr ON rr.qid = qs.qid AND rr.collection = c.collection LEFT JOIN top ON top.qid = qs.qid AND top.collection = c.collection),
c AS (SELECT a.qid, a.first_rank AS rank_a, a.top AS top_a, b.first_rank AS rank_b, b.top AS top_b,
  CASE WHEN coalesce(b.first_rank, 11) < coalesce(a.first_rank, 11) THEN 'better' WHEN coalesce(b.first_rank, 11) > coalesce(a.first_rank, 11) THEN 'worse' ELSE 'tie' END AS change
  FROM f a JOIN f b ON a.qid = b.qid AND a.collection = 'base' AND b.collection = 'flat')"""

_NEAR = """(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.qid, b.vec_id, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS score
  FROM (__Q__) a, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b))"""
near = lambda queries: _NEAR.replace("__Q__", queries)
RRF = f"""{SEARCH}, {d_search('sparse', 0.75, 40)},
dense AS (SELECT qid, vec_id AS doc_id, rank FROM {near('SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id')} WHERE rank <= 40),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT qid, doc_id, list_reduce(list_sort(list(1 / (60 + rank))), lambda x, y: x + y) AS score FROM (SELECT qid, doc_id, rank FROM sparse UNION ALL SELECT * FROM dense) GROUP BY qid, doc_id)) WHERE rank <= 10)"""

_h1, _h2, _h3 = "CASE WHEN doc_id % 2 = 0 THEN lang END", "CASE WHEN doc_id % 3 = 0 THEN source END", "CASE WHEN doc_id % 5 = 0 THEN 'deep' END"
_w = "OVER (PARTITION BY doc_id ORDER BY line_no)"


def _header(n: int) -> str:
    at = f"max(CASE WHEN level = {n} THEN line_no END) {_w}"
    reset = f"max(CASE WHEN level > 0 AND level < {n} THEN line_no END) {_w}"
    title = f"last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) {_w}"
    return f"CASE WHEN {reset} IS NULL OR {at} > {reset} THEN {title} END AS h{n}"


CHUNKS = "SELECT doc_id, name, t, unnest(range(greatest(ceil((length(t) - 50) / 450.0), 1)::BIGINT)) AS chunk_no FROM (SELECT doc_id, coalesce(text, '') AS t, " + c.FILE_NAME + " AS name FROM documents)"
_line = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
_depth = lambda t: " + ".join(f"CASE WHEN {t}.h{n} IS NULL THEN 0 ELSE 1 END" for n in (1, 2, 3))


def d_sections(docs: str) -> str:
    """CTEs; the last is sec (doc_id, section_no, text, h1, h2, h3) of (doc_id, text) rows without code fences."""
    return f"""sl AS (SELECT doc_id, unnest(list_transform(string_split(text, {NL}), lambda x: {_line})) AS line, unnest(range(len(string_split(text, {NL})))) AS line_no FROM ({docs})),
sh AS (SELECT *, length(regexp_extract(line, '^(#{{1,3}})(?: |$)', 1)) AS level, trim(regexp_replace(line, '^#{{1,3}}', '')) AS title FROM sl),
sf AS (SELECT *, {_header(1)}, {_header(2)}, {_header(3)}, sum(CASE WHEN level > 0 OR line = '' THEN 1 ELSE 0 END) {_w} AS block FROM sh),
sb AS (SELECT doc_id, block, h1, h2, h3, string_agg(line, {NL} ORDER BY line_no) AS body, arg_max(line, line_no) AS last FROM sf WHERE line <> '' GROUP BY ALL),
sn AS (SELECT b.*, CASE WHEN a.doc_id IS NULL THEN 1 WHEN a.h1 IS NOT DISTINCT FROM b.h1 AND a.h2 IS NOT DISTINCT FROM b.h2 AND a.h3 IS NOT DISTINCT FROM b.h3 THEN 0
  WHEN {_depth("a")} < {_depth("b")} AND starts_with(a.last, '#') THEN 0 ELSE 1 END AS fresh
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS k FROM sb) b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) + 1 AS k FROM sb) a ON a.doc_id = b.doc_id AND a.k = b.k),
sg AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY block) - 1 AS section_no FROM sn),
sec AS (SELECT doc_id, section_no::BIGINT AS section_no, string_agg(body, '  ' || {NL} ORDER BY block) AS text,
  arg_max({{'h': h1}}, block).h AS h1, arg_max({{'h': h2}}, block).h AS h2, arg_max({{'h': h3}}, block).h AS h3 FROM sg GROUP BY doc_id, section_no)"""


def d_chunks(docs: str, size: int = 500, overlap: int = 50) -> str:
    """CTEs; the last is chunk (id, chunk_no, text) of (id, text) rows: pieces by each separator in turn, runs of small ones folded to windows."""
    out, ids = [], []
    for n, mark in enumerate((f"{NL} || {NL}", NL, "' '"), 1):
        before = "".join(f"r{i}, " for i in range(1, n))
        source = docs if n == 1 else f"SELECT id, {before}ps[1] AS text FROM run{n - 1} WHERE over"
        cut = f"list_filter(list_transform(string_split(text, {mark}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {mark} || x END), lambda x: x <> '')"
        own = f"PARTITION BY id, {before}1 ORDER BY k"
        out.append(f"""piece{n} AS (SELECT id, {before}unnest(c) AS p, unnest(range(len(c))) AS k FROM (SELECT id, {before}{cut} AS c FROM ({source}))),
run{n} AS (SELECT id, {before}r{n}, list(p ORDER BY k) AS ps, bool_or(length(p) >= {size}) AS over FROM (
  SELECT *, sum(CASE WHEN k = 0 OR length(p) >= {size} OR big THEN 1 ELSE 0 END) OVER ({own}) AS r{n} FROM (SELECT *, lag(length(p) >= {size}) OVER ({own}) AS big FROM piece{n})) GROUP BY id, {before}r{n})""")
        ids.append(f"SELECT id, {before}r{n}, {''.join(f'0 AS r{i}, ' for i in range(n + 1, 4))}ps FROM run{n} WHERE NOT over")
    chars = "lambda z: length(z)"
    kept = f"list_min(list_filter(range(len(a.w) + 1), lambda d: coalesce(list_sum(list_transform(a.w[d + 1:], {chars})), 0) <= least({overlap}, {size} - x.n)))"
    fold = f"""list_reduce(list_transform(ps, lambda p: {{'w': [p], 'n': length(p), 'o': []::VARCHAR[]}}), lambda a, x: CASE WHEN a.n + x.n > {size}
  THEN {{'w': a.w[{kept} + 1:] || x.w, 'n': (coalesce(list_sum(list_transform(a.w[{kept} + 1:], {chars})), 0) + x.n)::BIGINT, 'o': a.o || [array_to_string(a.w, '')]}}
  ELSE {{'w': a.w || x.w, 'n': a.n + x.n, 'o': a.o}} END)"""
    out.append(f"""small AS ({" UNION ALL ".join(ids)}),
fold AS (SELECT id, r1, r2, r3, f.o || [array_to_string(f.w, '')] AS c FROM (SELECT id, r1, r2, r3, {fold} AS f FROM small)),
wide AS (SELECT id, r1, r2, r3, list_transform(range((greatest(ceil((length(ps[1]) - {size}) / {size - overlap}.0), 0) + 1)::BIGINT), lambda i: substr(ps[1], i * {size - overlap} + 1, {size})) AS c FROM run3 WHERE over),
every AS (SELECT id, r1, r2, r3, unnest(list_transform(c, lambda x: {_line})) AS text, unnest(range(len(c))) AS i FROM (SELECT * FROM fold UNION ALL SELECT * FROM wide)),
chunk AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY r1, r2, r3, i) - 1 AS chunk_no, text FROM every WHERE text <> '')""")
    return ",\n".join(out)


_stem = "regexp_replace(regexp_extract(name, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_part = lambda n: f"CASE WHEN contains({_stem}, '_high_enrage_') THEN string_split({_stem}, '_high_enrage_')[{n}] ELSE {_stem} END"
SCORES = (
    "s0 AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in c.SCORED.items()) + " FROM labels),\n"
    "s1 AS (SELECT *, trim(answer) = '' AS empty, CASE WHEN trim(answer) <> '' THEN CASE WHEN contains(lower(answer), 'cannot answer') THEN true ELSE verdict END END AS refused FROM s0),\n"
    "s AS (SELECT id, answerable, empty, refused, CASE WHEN NOT empty AND answerable AND NOT coalesce(refused, false) THEN faithfulness END AS faithfulness,\n"
    "  CASE WHEN NOT empty AND answerable AND NOT coalesce(refused, false) THEN relevancy END AS relevancy FROM s1)"
)
_yes = lambda r: f"CASE WHEN regexp_matches(lower({r}), '\\byes\\b') THEN true WHEN regexp_matches(lower({r}), '\\bno\\b') THEN false END"
_rating = lambda r: f"least(try_cast(nullif(regexp_extract({r}, '\\d+(?:\\.\\d+)?'), '') AS DOUBLE) / 10, CASE WHEN regexp_matches({r}, '\\d') THEN 1.0 END)"
_tries = lambda a, b: f"CASE WHEN {a} IS NOT NULL THEN 0 WHEN {b} IS NOT NULL THEN 1 ELSE 2 END::BIGINT"

#: doc_id and an embed's lines: title, description, one video.
EMBEDS = f"""SELECT doc_id, CASE WHEN lower(t) = 'table of contents' THEN '' ELSE array_to_string(list_filter(
  [CASE WHEN t <> '' THEN '### ' || t END, CASE WHEN d <> '' THEN d END, '- Example kill video, Kill (5:25): https://youtu.be/' || doc_id], lambda p: p IS NOT NULL), {NL}) END AS x
FROM (SELECT doc_id, trim('__' || source || '__', '_ ') AS t, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS d FROM documents)"""

def d_ingest() -> str:
    """CTEs of the whole way into an index: texts with an embed, cleaned, with band tokens, in sections and chunks; the last is cut (doc_id, section_no, chunk_no, text, h1, h2, h3)."""
    embedded = f"'# Top' || {NL} || x || {NL} || 'between' || {NL} || '{{broken' || {NL} || 'end'"
    whole = f"SELECT doc_id, {d_expand('text')} || {embedded} AS text FROM ({MARKED}) JOIN ({EMBEDS}) USING (doc_id)"
    lines = f"SELECT doc_id, unnest(string_split(text, {NL})) AS line, unnest(range(len(string_split(text, {NL})))) AS line_no FROM clean"
    return f"""clean AS MATERIALIZED (SELECT doc_id, {d_blank(d_bullets(d_strip("text")))} AS text FROM ({whole})),
tagged AS MATERIALIZED (SELECT doc_id, string_agg(CASE WHEN tokens = '' THEN line ELSE line || ' [' || tokens || ']' END, {NL} ORDER BY line_no) AS text FROM ({d_bands(lines, "doc_id, line_no")}) GROUP BY doc_id),
{d_sections("SELECT * FROM tagged")},
{d_chunks("SELECT doc_id * 100000 + section_no AS id, text FROM sec")},
cut AS (SELECT doc_id, section_no, chunk_no, chunk.text, h1, h2, h3 FROM chunk JOIN sec ON id = doc_id * 100000 + section_no)"""


ORACLES = {
    "scan_corpus": f"SELECT doc_id, source, length(text)::BIGINT AS chars, len(string_split(text, {NL}))::BIGINT AS lines FROM documents",
    "index_stats": "SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source",
    "source_parts": f"SELECT doc_id, {_part(2)} AS style, {_part(1)} AS boss FROM (SELECT doc_id, {c.FILE_NAME} AS name FROM documents)",
    "load_chunks": "SELECT doc_id, coalesce(source, '') AS source, regexp_replace(lower(coalesce(lang, '')), '[^a-z0-9]', '', 'g') AS section, md5(coalesce(CASE WHEN doc_id % 3 = 1 THEN nullif(text, '') END, CASE WHEN doc_id % 6 <> 0 THEN text END, '')) AS digest FROM documents",
    "build_index": "SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS chunk_id, doc_id, source FROM documents",
    "registry_latest": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
a AS (SELECT unnest(['click', 'view', 'nothing', 'build']) AS event_type UNION SELECT event_type FROM events)
SELECT a.event_type, CASE a.event_type WHEN 'click' THEN -5 WHEN 'build' THEN -6 ELSE coalesce(k.event_id, -1) END AS event_id,
  CASE a.event_type WHEN 'click' THEN '7' WHEN 'build' THEN 'unknown' ELSE coalesce(k.user_id::VARCHAR, 'unknown') END AS built_by FROM a LEFT JOIN k ON a.event_type = k.event_type AND k.n = 1""",
    "runs_leaderboard": "SELECT user_id AS run_name, round(avg(value), 6) AS mrr_at_10, count(*) AS questions FROM events GROUP BY user_id ORDER BY avg(value) DESC NULLS LAST, 1",
    "metric_rows": f"{RUNS}, w AS ({RATES}) UNPIVOT (SELECT * EXCLUDE (questions) FROM w) ON * EXCLUDE (collection) INTO NAME metric VALUE value",
    "expand_tokens": digest(MARKED, d_expand("text")),
    "unmapped_codes": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '<:([a-zA-Z0-9_]+):\\d+>', 1), lambda x: NOT list_contains([{', '.join(map(q, NAMES))}], x)))), ' ') AS codes FROM ({MARKED})",
    "collapse_repeats": digest(MARKED, d_collapse("text")),
    "tidy_links": digest(MARKED, sub("text", r"\[([^\]]*)\]\((https?://[^)]+)\)", r"'\2'")),
    "embed_to_text": f"SELECT doc_id, length(x)::BIGINT AS chars, md5(x) AS digest FROM ({EMBEDS})",
    "flatten_embeds": f"SELECT doc_id, length(x)::BIGINT AS chars, md5(x) AS digest FROM (SELECT doc_id, '# Top' || {NL} || x || {NL} || 'between' || {NL} || '{{broken' || {NL} || 'end' AS x FROM ({EMBEDS}))",
    "strip_markup": digest(MARKED, d_strip("text")),
    "normalize_bullets": digest(MARKED, d_bullets("text")),
    "tidy_blank_lines": digest(MARKED, d_blank("text")),
    "clean_corpus": digest(MARKED, d_clean("text")),
    "shrinkage": f"SELECT doc_id, round(100.0 * (length(text) - length(x)) / length(text), 6) AS percent FROM (SELECT doc_id, text, {d_clean('text')} AS x FROM ({MARKED}))",
    "normalize_text": digest("SELECT * FROM documents", "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g')"),
    "section_of": f"SELECT doc_id, coalesce({_h3}, {_h2}, {_h1}, '') AS section, coalesce({_h3}, {_h2}, '-') AS shown FROM documents",
    "band_tokens": f"SELECT o_orderkey, tokens FROM ({d_bands()})",
    "annotate_lines": f"SELECT o_orderkey, x || {NL} || 'no numbers here' || {NL} || x AS text FROM (SELECT o_orderkey, CASE WHEN tokens = '' THEN line ELSE line || ' [' || tokens || ']' END AS x FROM ({d_bands()}))",
    "annotate_query": f"SELECT o_orderkey, CASE WHEN tokens = '' THEN line ELSE line || ' ' || tokens END AS text FROM ({d_bands()})",
    "strip_tokens": f"SELECT o_orderkey, regexp_replace(({c.BAND_LINE}) || ' [enrageband0 enrageband500] kept [enrageband] [enrageband10]', '\\s*\\[(?:enrageband\\d+\\s*)+\\]', '', 'g') AS text FROM orders",
    "section_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line, unnest(range(len(string_split(text, {NL})))) AS line_no FROM ({MARKED})),
h AS (SELECT *, length(regexp_extract(line, '^(#{{1,3}})(?: |$)', 1)) AS level, trim(regexp_replace(line, '^#{{1,3}}', '')) AS title FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, md5(line) AS line, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) {_w} AS BIGINT) AS section_no, {_header(1)}, {_header(2)}, {_header(3)} FROM h""",
    "sections": f"WITH {d_sections(MARKED)} SELECT * REPLACE (md5(text) AS text) FROM sec",
    "chunk_recursive": f"WITH {d_chunks('SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL')} SELECT id AS doc_id, chunk_no, length(text)::BIGINT AS chars, md5(text) AS digest FROM chunk",
    "ingest_corpus": f"""WITH {d_ingest()}
SELECT row_number() OVER (ORDER BY doc_id, section_no, chunk_no) - 1 AS chunk_id, doc_id, section_no, chunk_no, coalesce(h3, h2, h1, '') AS section,
  regexp_extract(name, '([^/]*)$', 1) AS source, {_part(2)} AS style, {_part(1)} AS boss, length(text)::BIGINT AS chars, md5(text) AS digest
FROM cut JOIN (SELECT doc_id, {c.FILE_NAME} AS name FROM documents) USING (doc_id)""",
    "chunk_fixed": f"SELECT doc_id, chunk_no, length(x)::BIGINT AS chars, md5(x) AS digest FROM (SELECT doc_id, chunk_no, substr(t, chunk_no * 450 + 1, 500) AS x FROM ({CHUNKS}))",
    "chunk_metadata": f"SELECT doc_id, chunk_no, regexp_extract(name, '([^/]*)$', 1) AS source, {_part(2)} AS style, {_part(1)} AS boss FROM ({CHUNKS})",
    "bm25_postings": f"WITH {INDEX.replace('__WHERE__', '')} SELECT doc_id, term, tf, round({weight(0.75)}, 6) AS weight FROM tf, st",
    "query_terms": f"SELECT item_id, array_to_string(list_sort(list_distinct({tokens('text')})), ' ') AS terms FROM benchmark",
    "idf": f"WITH {INDEX.replace('__WHERE__', '')} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"{SEARCH}, {d_search('r', 0.75)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM r",
    "indexed_search": f"{SEARCH}, {d_search('r', 0.75)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM r",
    "updated_search": f"WITH {INDEX.replace('__WHERE__', 'WHERE doc_id % 8 <> 2')}, {QUESTIONS}, {d_search('r', 0.75)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM r",
    "index_history": f"""WITH d AS (SELECT doc_id, len({tokens('text')}) AS n FROM documents),
s AS (SELECT 1 AS snapshot, n + CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 0 END AS n FROM d WHERE doc_id % 4 <> 3
  UNION ALL SELECT 2, n FROM d UNION ALL SELECT unnest([3, 4]), n FROM d WHERE doc_id % 8 <> 2),
m AS (SELECT 2 AS snapshot, count(*) AS marks FROM d WHERE doc_id % 4 = 1 UNION ALL SELECT 3, count(*) FROM d WHERE doc_id % 4 = 1 OR doc_id % 8 = 2)
SELECT snapshot::BIGINT AS snapshot, count(*) AS documents, sum(n)::BIGINT AS tokens, CASE WHEN snapshot IN (2, 3) THEN 2 ELSE 1 END::BIGINT AS segments, coalesce(any_value(marks), 0) AS marks
FROM s LEFT JOIN m USING (snapshot) GROUP BY snapshot""",
    "token_overlap": f"""WITH p AS (SELECT item_id, list_distinct({tokens('b.text')}) AS x, list_distinct({tokens('d.text')}) AS y FROM benchmark b JOIN documents d ON item_id = doc_id),
o AS (SELECT item_id, list_sort(list_intersect(x, y)) AS s, list_sort(list_filter(x, lambda t: NOT list_contains(y, t))) AS a, list_sort(list_filter(y, lambda t: NOT list_contains(x, t))) AS b FROM p)
SELECT item_id, array_to_string(s, ' ') AS shared, array_to_string(a, ' ') AS only_a, array_to_string(b, ' ') AS only_b, len(a) = 0 AND len(b) = 0 AS same FROM o""",
    "dense_topk": f"SELECT qid, vec_id, round(score, 6) AS score, rank FROM {near('SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0')} WHERE rank <= 10",
    "rrf_fusion": f"{RRF} SELECT qid, doc_id, round(score, 6) AS score, rank FROM fused",
    "hybrid_search": f"{RRF} SELECT qid, rank, doc_id, source, md5(text) AS digest FROM fused JOIN (SELECT doc_id, source, text FROM documents) USING (doc_id)",
    "filtered_search": f"WITH {INDEX.replace('__WHERE__', chr(87) + 'HERE lang = ' + q('en'))}, {QUESTIONS}, {d_search('r', 0.75)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM r",
    "format_context": f"""{SEARCH}, {d_search('r', 0.75, 3)},
p AS (SELECT qid, rank, '[From the ' || CASE doc_id % 3 WHEN 0 THEN 'Hybrid Melee/Magic' WHEN 1 THEN 'guide' ELSE lang END || ' guide]' || {NL} || text AS part FROM r JOIN (SELECT doc_id, lang, text FROM documents) USING (doc_id)),
x AS (SELECT qid, string_agg(part, {NL} || {NL} ORDER BY rank) AS context FROM p GROUP BY qid)
SELECT qid, length(context)::BIGINT AS chars, md5(context) AS digest FROM x""",
    "fill_prompt": f"""{SEARCH}, {d_search('r', 0.75, 3)},
p AS (SELECT qid, rank, '[From the ' || CASE doc_id % 3 WHEN 0 THEN 'Hybrid Melee/Magic' WHEN 1 THEN 'guide' ELSE lang END || ' guide]' || {NL} || text AS part FROM r JOIN (SELECT doc_id, lang, text FROM documents) USING (doc_id)),
x AS (SELECT qid, 'Answer the question from the context alone.' || {NL} || {NL} || 'Context:' || {NL} || string_agg(part, {NL} || {NL} ORDER BY rank) || {NL} || {NL} || 'Question:' || {NL} || any_value(qs.text) || {NL} AS t FROM p JOIN qs USING (qid) GROUP BY qid)
SELECT qid, length(t)::BIGINT AS chars, md5(t) AS digest FROM x""",
    "dense_only_search": f"SELECT qid, vec_id AS doc_id, round(score, 6) AS score, rank FROM {near('SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id')} WHERE rank <= 10",
    "qrels": f"WITH {QUESTIONS}, {QRELS} SELECT * FROM rel",
    "qrels_short": f"WITH qs AS (SELECT item_id AS qid, substr(text, 2 + item_id % 5, 1 + item_id % 12) AS phrase FROM benchmark), {QRELS} SELECT * FROM rel",
    "qrels_size": f"WITH {QUESTIONS}, {QRELS} SELECT qid, count(*) AS n_relevant FROM rel GROUP BY qid",
    "unlabelled_questions": f"WITH {QUESTIONS}, {QRELS} SELECT qid FROM qs WHERE phrase <> '' AND qid NOT IN (SELECT qid FROM rel)",
    "stratified_limit": "SELECT qid, answerable FROM (SELECT item_id AS qid, item_id % 4 <> 0 AS answerable, row_number() OVER (PARTITION BY item_id % 4 <> 0 ORDER BY item_id) AS n FROM benchmark) WHERE n <= CASE WHEN answerable THEN 8 ELSE 2 END",
    "reciprocal_rank": f"{RUNS} SELECT * REPLACE (coalesce(first_rank, 0) AS first_rank, round(rr, 6) AS rr) FROM rr",
    "hit_rates": f"{RUNS} {RATES}",
    "mrr_by_tag": f"""{RUNS}, tags AS (SELECT qid, unnest(['all', 'len' || k]) AS tag FROM qs)
SELECT tag, count(*) AS n, round(avg(a.rr), 6) AS base, round(avg(coalesce(b.rr, 0)), 6) AS flat FROM tags JOIN rr a ON tags.qid = a.qid AND a.collection = 'base' LEFT JOIN rr b ON tags.qid = b.qid AND b.collection = 'flat' GROUP BY tag HAVING count(*) >= 4""",
    # two-sided p: 1 minus an integral of cos^(n - 2) up to atan(|t| / sqrt(n - 1)), by Simpson's rule
    "paired_ttest": f"""{RUNS}, d AS (SELECT b.collection, b.rr - a.rr AS d FROM rr a JOIN rr b USING (qid) WHERE a.collection = 'base' AND b.collection = 'flat'),
s AS (SELECT collection, count(*) AS n, avg(d) AS mean_diff, avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) AS t FROM d GROUP BY collection),
h AS (SELECT *, atan(abs(t) / sqrt(n - 1)) / 4000 AS step FROM s),
p AS (SELECT *, 1 - 2 / sqrt(pi()) * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) * step / 3
  * list_sum(list_transform(range(4001), lambda i: CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i * step), n - 2))) AS p FROM h)
SELECT collection, n, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(p, 6) AS p, CASE WHEN p < 0.05 THEN 'significant' WHEN p IS NOT NULL THEN 'not significant' END AS verdict FROM p""",
    "compare_ranks": f"""{COMPARED}
SELECT qid, coalesce(rank_a, 11) AS rank_a, round(top_a, 6) AS top_a, coalesce(rank_b, 11) AS rank_b, round(top_b, 6) AS top_b, change FROM c""",
    "rank_changes": f"""{COMPARED}
SELECT count(*) FILTER (coalesce(rank_a, 0) <> coalesce(rank_b, 0)) AS differing, count(*) FILTER (change = 'better') AS better, count(*) FILTER (change = 'worse') AS worse FROM c""",
    "split_claims": """SELECT conv_id, turn, len(l)::BIGINT AS n_claims, array_to_string(l, '|') AS claims FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])["'')\\]]*\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' -•"''')), lambda p: length(p) > 15)[1:8] AS l FROM conversations)""",
    "refusal_flag": f"SELECT conv_id, turn, CASE WHEN {' OR '.join(f'contains(lower(a), {q(x)})' for x in REFUSALS)} THEN true ELSE turn % 3 = 0 END AS refused FROM (SELECT conv_id, turn, {c.ANSWER} AS a FROM conversations)",
    "parse_yes_no": f"SELECT conv_id, turn, coalesce({_yes('a')}, {_yes('b')}) AS verdict FROM (SELECT conv_id, turn, {c.REPLY} AS a, {c.REPLY.replace('conv_id + turn', 'conv_id + turn + 1')} AS b FROM conversations)",
    "parse_score": f"SELECT conv_id, turn, least(try_cast(nullif(regexp_extract(a, '\\d+(?:\\.\\d+)?'), '') AS DOUBLE) / 10, CASE WHEN regexp_matches(a, '\\d') THEN 1.0 END) AS relevancy FROM (SELECT conv_id, turn, {c.RATING} AS a FROM conversations)",
    "judge_attempts": f"""WITH r AS (SELECT conv_id, turn, {_yes('a')} AS y1, {_yes('b')} AS y2, {_rating('c')} AS r1, {_rating('d')} AS r2 FROM (
  SELECT conv_id, turn, {c.REPLY} AS a, {c.REPLY.replace('conv_id + turn', 'conv_id + turn * 3')} AS b, {c.RATING} AS c, {c.RATING.replace('conv_id + turn', 'conv_id + turn * 3')} AS d FROM conversations))
SELECT conv_id, turn, coalesce(y1, y2) AS verdict, {_tries('y1', 'y2')} AS verdict_retries, y1 IS NULL AND y2 IS NULL AS verdict_failed,
  coalesce(r1, r2) AS relevancy, {_tries('r1', 'r2')} AS rating_retries, r1 IS NULL AND r2 IS NULL AS rating_failed FROM r""",
    "model_results": "SELECT conv_id, turn, CASE WHEN length(text) % 7 <> 0 THEN md5(text) END AS result, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: no result' END AS error FROM conversations",
    "run_times": "SELECT coalesce(r, 'all runs') AS run_name, count(*) AS n, true AS p50_near, true AS p95_near FROM (SELECT unnest([user_id::VARCHAR, NULL]) AS r FROM events WHERE value IS NOT NULL) GROUP BY r",
    "answer_timing": "SELECT count(*) AS answers, round(sum(length(text) / 10) / 60, 6) AS minutes, round(avg(length(text) / 10), 6) AS seconds_each FROM conversations",
    "score_record": f"WITH {SCORES} SELECT * FROM s",
    "faithfulness": f"SELECT conv_id AS id, round(avg(CASE v WHEN true THEN 1.0 WHEN false THEN 0.0 END), 6) AS faithfulness FROM (SELECT conv_id, {c.VERDICT} AS v FROM conversations) GROUP BY conv_id",
    "generation_summary": f"""WITH {SCORES} SELECT round(avg(faithfulness) FILTER (answerable), 6) AS faithfulness, round(avg(relevancy) FILTER (answerable), 6) AS relevancy,
round(avg(refused::INT) FILTER (NOT answerable AND refused IS NOT NULL), 6) AS refusal_rate, round(avg(refused::INT) FILTER (answerable AND refused IS NOT NULL), 6) AS false_refusal_rate, round(avg(empty::INT), 6) AS empty_answer_rate,
round(sum(CASE WHEN id % 13 = 0 THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN answerable THEN 10 ELSE 1 END), 6) AS judge_parse_failure_rate FROM s""",
}
