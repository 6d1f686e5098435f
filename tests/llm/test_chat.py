import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.chat import Rendered, digests, escape, format_conversations, inst_template, read_inst, unescape
from cairn.llm.queries import CONTROL

SCHEMA = "conv_id long, turn long, role string, text string"
TEXT = st.text(st.sampled_from("\\[]<>/sINST ab\n"), max_size=20)


@given(TEXT)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert "[INST]" not in escape(text).replace("\\[", "") and "</s>" not in escape(text).replace("\\<", "")


@settings(max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>"]), TEXT), max_size=6))
def test_turns_are_read_back(turns):
    r = Rendered(turns, inst_template)
    assert r.faithful() and not r.rewrites


def test_rewriting_templates_are_detected():
    def last_only(turns):  # drops earlier assistant turns' marks
        return "".join(f"<{r}>{escape(t)}" if i == len(turns) - 1 else escape(t) for i, (r, t) in enumerate(turns))

    assert Rendered([("user", "a"), ("assistant", "b")], last_only).rewrites
    header = lambda turns: "".join(f"{r}: {escape(t)}\n" for r, t in turns)
    assert not Rendered([("user", "a"), ("assistant", "b")], header).rewrites


def test_spans_after_a_rewrite_and_in_changing_frames():
    turns = [("user", "abc"), ("assistant", "b [x]"), ("user", "A"), ("assistant", "")] + [("user", f"t{i}") for i in range(9)]
    last_only = lambda ts: "".join(f"<{r}>{escape(t)}" if i == len(ts) - 1 else escape(t) + "|" for i, (r, t) in enumerate(ts))
    r = Rendered(turns, last_only)
    assert r.rewrites and r.faithful()
    numbered = lambda ts: "".join(f"{i}<{r}>{escape(t)}\n" for i, (r, t) in enumerate(ts))
    r = Rendered(turns, numbered)
    assert not r.rewrites and r.faithful()
    assert not Rendered(turns, lambda ts: f"{len(ts)} turns").faithful()


def test_digests_refuse_what_is_not_read_back(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "zz")], SCHEMA)
    lossy = lambda ts: "".join(f"<{r}>{escape(t).replace('q', '')}" for r, t in ts)
    read = lambda text: [(r, unescape(t)) for r, t in re.findall(r"<(\w+)>((?:[^\\<]|\\.)*)", text)]
    got = {r.conv_id: r for r in digests(format_conversations(df, lossy), read).collect()}
    assert got[1].turns_sha256 is got[1].loss_chars is got[1].loss_sha256 is got[1].n_turns is None
    assert got[2].loss_chars == 2 and got[2].loss_sha256 == hashlib.sha256(b"zz").hexdigest()


def test_a_template_that_drops_roles_is_refused(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "system", "q")], SCHEMA)
    dropping = lambda ts: "".join(f"<s>[INST] {escape(t)} [/INST]" for _, t in ts)
    for r in digests(format_conversations(df, dropping)).collect():
        assert r.turns_sha256 is r.loss_sha256 is r.n_turns is None and r.formatted_chars > 0
    # roles that share marks: a conversation with either is refused
    merged = lambda ts: "".join(f"<s>[INST] {escape(t)} [/INST]" if r in ("user", "system") else f" {escape(t)} </s>" for r, t in ts)
    assert not Rendered([("user", "a"), ("system", "b")], merged).faithful()


@settings(max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>", "a] b", "", "\\"]), TEXT), max_size=6))
def test_the_reader_gives_back_all_turns(turns):
    assert read_inst(inst_template(turns)) == turns


def test_the_reader_refuses_other_texts():
    for text in ("x", "<s>[INST] a[/INST]", "<s>[INST] a [/INST] tail", " a", "<s>[ROLE user] a [/ROLE]", "<s>[INST] a < b [/INST]"):
        assert read_inst(text) is None
    long = "a\\<[" * 300_000
    assert read_inst(inst_template([("user", long), ("assistant", long)])) == [("user", long), ("assistant", long)]


def brute(rows):
    by = {}
    for at, (c, n, r, t) in enumerate(rows):
        by.setdefault((c, at if c is None else 0), []).append((-1 if n is None else n, r or "", t or ""))
    out = []
    for (c, _), turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        out.append((c, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(inst_template([(r, t) for _, r, t in turns]))))
    return sorted(out, key=str)


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 100_000), (2, 1, "assistant", None), (2, 0, None, "x"), (3, None, "user", "y"), (3, 0, "user", "y"), (3, 0, "user", "y"), (None, 0, "user", "z"), (None, 1, "assistant", "z"), (None, 1, "assistant", "z"), (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)]
ROWS += [(9, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(300)] + [(2**60 + 1, 0, "assistant", "é🙂")]


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "none"])
def test_digests(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for table in (df, df.selectExpr("*", "'x' AS formatted", "1 AS starts")):
        assert sorted(map(tuple, digests(format_conversations(table)).collect()), key=str) == brute(rows)


def test_formatted_output(spark):
    r = format_conversations(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], SCHEMA)).first()
    assert r.formatted == "<s>[INST] q [/INST] a </s>" and r.faithful and not r.rewrites
    assert [r.formatted[a:b] for a, b in zip(r.starts, r.stops)] == ["q", "a"]
