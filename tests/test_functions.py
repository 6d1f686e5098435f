import json
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.config import Settings
from cairn.functions import bands, clean, judging
from cairn.functions.lookup import ALIASES, NAMES
from cairn.operators import chunking


@pytest.fixture
def apply(spark):
    """A text function on one value."""

    def run(f, text):
        return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x

    return run


def ladder(*values):
    return [f"enrageband{v}" for v in values]


BANDS = [
    ("**0-2500%:**", ladder(0, 500, 1000, 1500, 2000, 2500)),
    ("**2500%+:**", ladder(2500, 3000, 3500, 4000, 4500, 5000)),
    ("at 3000% enrage", ladder(3000)),
    ("below 2500%", ladder(0, 500, 1000, 1500, 2000)),
    ("below 2300%", ladder(0, 500, 1000, 1500)),
    ("under 300%", ladder(0)),
    ("above 4600%", ladder(4500, 5000)),
    ("9000%+", ladder(5000)),
    ("4000-3000%", []),
    ("100% adrenaline", []),
    ("2500%-4000% or below 2500%", ladder(2500, 3000, 3500, 4000, 0, 500, 1000, 1500, 2000)),
    ("3500%+ enrage", ladder(3500, 4000, 4500, 5000)),
    ("below \u0663\u0660\u0660\u0660% x", ladder(0, 500, 1000, 1500, 2000, 2500)),
    ("\uff14\uff10\uff10\uff10%+", ladder(4000, 4500, 5000)),
    ("\U0001d7d4\u096b\u0966\u0966-5\u06f0\u06f0\u06f0%", []),
    ("\U0001d7d2\u096b\u0966\u0966-5\u06f0\u06f0\u06f0%", ladder(4500, 5000)),
]


@pytest.mark.parametrize("text,want", BANDS)
def test_band_tokens(apply, text, want):
    assert apply(bands.band_tokens, text) == want


def test_annotations(apply):
    assert apply(bands.annotate, "a\nat 500% enrage\n") == "a\nat 500% enrage [enrageband500]\n"
    assert apply(bands.annotate_query, "at 500% enrage?") == "at 500% enrage? enrageband500"
    assert apply(bands.strip_tokens, "x [enrageband0 enrageband500] y [other]") == "x y [other]"


@pytest.mark.parametrize("mode,want", [("both", "Fractured Staff of Armadyl (fsoa)"), ("full", "Fractured Staff of Armadyl"), ("alias", "fsoa")])
def test_codes_by_mode(apply, mode, want):
    assert apply(lambda t: clean.expand_tokens(t, mode), "use <:fsoa:1>!") == f"use {want}!"
    assert apply(lambda t: clean.expand_tokens(t, mode), "<:bloat:1><:notarealthing:123>") == "Bloatnotarealthing"


def test_bad_mode_raises():
    with pytest.raises(ValueError):
        clean.expand_tokens(F.lit("x"), "nonsense")
    with pytest.raises(ValueError):
        Settings(emoji_mode="nonsense")


def test_dictionary():
    assert len(NAMES) == 116 and len(ALIASES) == 32 and set(NAMES) >= set(ALIASES)


def test_collapse(apply):
    assert apply(clean.expand_tokens, "Powder of Penance <:powderofpenance:1> Powder of Penance") == "Powder of Penance"
    assert apply(clean.collapse_repeats, "other other Bloat, Bloat") == "other other Bloat, Bloat"


def test_markup(apply, spark):
    raw = "# Boss <:bloat:1>\n.tag:intro\n⬥ Use <:soulsap:2>\n"
    assert apply(clean.clean_native, raw) == "# Boss Bloat\n- Use Soul Sap\n"
    df = spark.createDataFrame([(raw,)], "text string")
    once = clean.preprocess(df).first().text
    assert once == "# Boss Bloat\n- Use Soul Sap\n"
    assert clean.preprocess(spark.createDataFrame([(once,)], "text string")).first().text == once
    assert apply(clean.strip_markup, "a <#1> <@2> <!3> <@&4> <id:5>\n.\n.x\nb") == "a    <@&4> <id:5>\nb"
    assert apply(clean.tidy_blank_lines, "　 a\n\n\n\nb \n\xa0") == "a\n\nb\n"
    assert apply(clean.tidy_links, "[Link](https://youtu.be/abc) [3500%](<https://youtu.be/x>)") == "https://youtu.be/abc [3500%](<https://youtu.be/x>)"
    assert apply(clean.normalize_text, "__Presets & Relics 2__") == "presetsrelics2"


def embed(**content):
    return json.dumps({"embed": content}, indent=1)


def test_embeds(spark):
    field = {"name": "__3000% GM timer__ (5:25)", "value": "[3500%](<https://youtu.be/x>)", "inline": True}
    texts = [
        "a\n" + embed(title="__T__", description=" d ", fields=[field, {"name": "Example Kills", "value": "https://youtube.com/y)."}, {"name": "n:", "value": "v"}, {"value": "only"}]) + "\n.embed:json\nb",
        embed(title="Table of Contents") + "\n.embed:json\nb",
        "{broken\n .embed:json \nend",
        "plain",
        None,
    ]
    got = {r.i: r.text for r in clean.flatten_embeds(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert got[0] == "a\n### T\nd\n- Example kill video, 3000% GM timer__ (5:25): https://youtu.be/x\n- Example kill video, Arch-Glacor: https://youtube.com/y\n**n**\nv\nonly\nb"
    assert got[1] == "\nb" and got[2] == "{broken\nend" and got[3] == "plain" and got[4] is None


def test_claims(apply):
    text = 'He said "go on now please." Then, it works very well! short.\n- bullet item that is long\n\nfinal line has enough text'
    assert apply(judging.split_claims, text) == ['He said "go on now please.', "Then, it works very well!", "bullet item that is long", "final line has enough text"]
    assert len(apply(judging.split_claims, "a long enough sentence. " * 20)) == 8


@pytest.mark.parametrize("reply,want", [("Yes.", True), ("no", False), ("yes and no", True), ("nope", None), (None, None)])
def test_yes_no(apply, reply, want):
    assert apply(judging.yes_no, reply) is want


@pytest.mark.parametrize("reply,want", [("8", 0.8), ("Score: 7.5/10", 0.75), ("12", 1.0), ("-5", 0.5), ("n/a", None)])
def test_relevancy(apply, reply, want):
    assert apply(judging.relevancy, reply) == want


def test_scores_and_summary(spark):
    rows = [(1, True, "fine", False, 1.0, 0.5), (2, True, "I cannot answer", None, 1.0, 1.0), (3, False, "a", True, 1.0, 1.0), (4, True, " \n", True, 1.0, 1.0), (5, True, "unclear", None, 0.5, None)]
    df = spark.createDataFrame(rows, "id int, answerable boolean, answer string, verdict boolean, faithfulness double, relevancy double")
    scores = judging.score_record(df)
    got = {r.id: tuple(r)[2:] for r in scores.collect()}
    assert got == {1: (False, False, 1.0, 0.5), 2: (False, True, None, None), 3: (False, True, None, None), 4: (True, None, None, None), 5: (False, None, 0.5, None)}
    s = judging.summarise(scores).first()
    assert (s.faithfulness, s.relevancy, s.refusal_rate, s.false_refusal_rate, s.empty_answer_rate, s.judge_parse_failure_rate) == (0.75, 0.5, 1.0, 0.5, 0.2, 0.0)
    assert judging.unreliable(0.06) and not judging.unreliable(0.05)


def test_attempts_and_timing(spark):
    rows = [(["hm", "yes"],), (["no", "yes"],), (["hm", "?", "yes"],), ([],)]
    df = spark.createDataFrame(rows, "r array<string>")
    retries, failed = judging.attempts(F.col("r"), judging.yes_no)
    assert [tuple(x) for x in df.select(retries, failed).collect()] == [(1, False), (0, False), (2, True), (0, True)]
    assert df.select(judging.first_relevancy(F.array(F.lit("n/a"), F.lit("7")))).first()[0] == 0.7
    timed = judging.timing(spark.createDataFrame([(30.0,), (90.0,), (None,)], "seconds double")).first()
    assert tuple(timed) == (3, 2.0, 60.0)


def test_settings():
    s = Settings().given(top_k=7, hybrid=None)
    assert s.top_k == 7 and s.hybrid and s.depth(0) == 7 and s.depth(2) == 2
    with pytest.raises(ValueError):
        Settings().given(nothing=1)


OBJECT = '{"title": "T",\n "fields": [\n  {"name": "n",\n   "value": "}"}\n ]\n}'
ENDINGS = [
    (OBJECT, 0),
    ("7\n" + OBJECT, 2),
    ("{\n" + OBJECT, 2),
    ("{}\n" + OBJECT + "\n \t\n", 3),
    ("  \r{}", 0),
    ("{}\nnot JSON", None),
    ("[{}]", None),
    ("x {}", None),
    ('"{"', None),
    ("{" * 50_000, None),
    ("", None),
]


@pytest.mark.parametrize("text,start", ENDINGS)
def test_object_at_end(text, start):
    found = clean.object_at_end(text)
    assert (found and found[0]) == start
    if found:
        assert found[1] == json.loads(text[found[0] :])


def test_embeds_in_order(spark):
    mark = "\n\t.embed:json \n"
    text = f"a\n{OBJECT}{mark}b\n{{x{mark}{mark}[1]{mark}{OBJECT}{mark[:-1]}"
    got = clean.flatten_embeds(spark.createDataFrame([(text,)], "text string")).first().text
    shown = "### T\n**n**\n}"
    assert got == f"a\n{shown}\nb\n{{x\n\n[1]\n{shown}"


def test_embeds_are_cut_a_few_texts_at_a_time(monkeypatch):
    texts = ['# T\n{"embed": {"title": "a"}}\n.embed:json\nend', None, "plain", "{broken\n.embed:json"] * 50
    whole = clean._cut_embeds(pa.array(texts)).to_pylist()
    assert whole == [None if t is None else clean._pieces(t) for t in texts] and clean._cut_embeds(pa.array([], pa.string())).to_pylist() == []
    monkeypatch.setattr(clean, "STEP_ROWS", 7)
    seen = []
    array = pa.array
    monkeypatch.setattr(clean.pa, "array", lambda x, *a: seen.append(len(x)) or array(x, *a))
    assert clean._cut_embeds(array(texts)).to_pylist() == whole and max(seen) == 7


def test_doubled_names_are_found_in_one_pass(spark):
    """As a look for every name in every text does it, longest names first."""
    rng, names = random.Random(3), sorted(set(NAMES.values()), key=lambda n: (-len(n), n))
    texts = [" ".join(rng.choice([*rng.sample(names, 3), "x", "Soul", "Death", "of", "(flanking)"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [" ".join(n.split(" ")[0] + " " + n for _ in range(3)) for n in names] + ["".join(f"{n} {n}" for n in names), "a" + f"{names[0]} " * 3, "", None]

    def plain(t):
        for n in names if t else ():
            t = re.sub(f"(?:{re.escape(n)} )+{re.escape(n)}", n, t)
        return t

    for t in filter(None, texts):
        found = {m.group(1) for m in re.finditer(clean._STANDS, t)}
        assert {n for n in names if n in t} == {n for n in names if any(f.startswith(n) for f in found)}
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clean.collapse_repeats(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_large_pieces_are_looked_for_in_linear_time():
    pattern = re.search(r"RLIKE '([^']*)'", chunking.recursive_chunks("text")).group(1)
    pattern = re.compile(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m.group(1), 16)), pattern))
    began = time.process_time()
    assert not pattern.search(("x" * 480 + "\n") * 20000) and time.process_time() - began < 0.5
    assert pattern.search("x" * 499) and pattern.search("a\n" + "x" * 499 + "\nb") and not pattern.search("a\n" + "x" * 498 + "\nb")
