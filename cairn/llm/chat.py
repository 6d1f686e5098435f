"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. The renderer
gives it successive prefixes of a conversation and compares consecutive outputs: where
the earlier output begins the later one, the rest is the new turn's span. Within a span,
where the content stands is found by rendering the same prefix with two probe texts: what
the two have in common before and after is the template's own. A template whose output
for a prefix does not begin the next output rewrites history; this is reported and such a
conversation's spans are found on the final output, each turn probed in the whole
conversation. What a turn's role had around its text before is tried first, and probed
anew where the text is not read back.

The default template escapes control strings inside texts and roles reversibly, so roles,
turns and contents are read back from the output alone, by a reader that knows its marks.
Digests come from what is read there; they are null where it can't be read, where a text
is not read back, or where a turn's output does not tell its role from another one.

Conversations are streamed: rows are dealt by conversation and sorted, and a task holds
the conversation at hand only. A black box must be given every prefix, so the time of a
conversation grows with the square of its turns.

Defined cases: null text and null role are empty; turns are in order of turn (null
first), then role and text; rows repeated in full are turns of their own; a row with a
null conv_id names no conversation and stands alone; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No unescaped ``<`` or ``[`` stays, and every control string of the template begins with one."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """Nor an unescaped ``]``, which ends a role."""
    return escape(role).replace("]", "\\]")


def inst_template(turns: list[Turn]) -> str:
    """User turns stand in [INST] marks, assistant turns end with </s>, others carry their role."""
    out = []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
        else:
            out.append(f"<s>[ROLE {escape_role(role)}] {text} [/ROLE]")
    return "".join(out)


_TURN = re.compile(
    r"""<s>\[INST\]\ (?P<user>(?:[^\\<\[]++|\\.)*+)\[/INST\]
    |\ (?P<assistant>(?:[^\\<\[]++|\\.)*+)</s>
    |<s>\[ROLE\ (?P<role>(?:[^\\<\[\]]++|\\.)*+)\]\ (?P<other>(?:[^\\<\[]++|\\.)*+)\[/ROLE\]""",
    re.S | re.X,
)


def read_inst(text: str) -> list[Turn] | None:
    """The turns that an output of the default template holds; None where it is no such output."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            return None
        kind = found.lastgroup
        content = found[kind]
        role = kind if kind in ("user", "assistant") else unescape(found["role"])
        # a space stands before the closing mark; other roles than these two have marks of their own
        if not content.endswith(" ") or kind == "other" and role in ("user", "assistant"):
            return None
        turns.append((role, unescape(content[:-1])))
        at = found.end()
    return turns


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def _frame(a: str, z: str) -> tuple[int, int]:
    """How much two outputs have in common before and after."""
    before = _common(a, z)
    return before, _common(a[before:][::-1], z[before:][::-1])


class Rendered:
    """The output for a conversation, and for each turn the span of its content in it."""

    def __init__(self, turns: list[Turn], template: Template, undo: Callable[[str], str] = unescape):
        self.turns, self.template, self.rewrites, self.contents = turns, template, False, []
        outputs, frames = [template([])], {}
        for i, (role, text) in enumerate(turns):
            now = template(turns[: i + 1])
            if not now.startswith(outputs[-1]):
                self.rewrites = True
                break
            start = len(outputs[-1])
            key = (role, i == 0)
            before, after = frames.get(key, (0, 0))
            if key not in frames or start + before > len(now) - after or undo(now[start + before : len(now) - after]) != text:
                before, after = frames[key] = _frame(*(template([*turns[:i], (role, x)])[start:] for x in ("A", "Z")))
            self.contents.append((start + before, len(now) - after))
            outputs = [now]
        self.text = outputs[-1]
        if self.rewrites:
            self.text, self.contents = template(turns), []
            for i, (role, _) in enumerate(turns):
                before, after = _frame(*(template([*turns[:i], (role, x), *turns[i + 1 :]]) for x in ("A", "Z")))
                self.contents.append((min(before, len(self.text)), max(len(self.text) - after, min(before, len(self.text)))))

    def content(self, i: int, undo: Callable[[str], str] = unescape) -> str:
        start, stop = self.contents[i]
        return undo(self.text[start:stop])

    def faithful(self, undo: Callable[[str], str] = unescape) -> bool:
        """True if every turn's text is read back from the output as it was, and no role gives the output of another."""
        return all(self.content(i, undo) == t for i, (_, t) in enumerate(self.turns)) and self.tells_roles()

    def tells_roles(self) -> bool:
        """True if each role's turn alone differs in output from the same turn of any other role here and of one that is not."""
        known = {r for r, _ in self.turns}
        alone = {r: self.template([(r, "x")]) for r in (*known, f"not {max(known, default='')}")}
        return len(set(alone.values())) == len(alone)


def format_conversations(conversations: DataFrame, template: Template = inst_template, undo: Callable[[str], str] = unescape) -> DataFrame:
    """conv_id, formatted, contents (start, stop of each turn's text), roles, rewrites, faithful."""
    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, formatted string, roles array<string>, starts array<long>, stops array<long>, rewrites boolean, faithful boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, turns, out = None, [], []

        def end() -> None:
            if turns:
                r = Rendered(list(turns), template, undo)
                out.append((conv, r.text, [x for x, _ in turns], [x for x, _ in r.contents], [x for _, x in r.contents], r.rewrites, r.faithful(undo)))

        names = ["conv_id", "formatted", "roles", "starts", "stops", "rewrites", "faithful"]
        for pdf in batches:
            for c, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                c = None if pd.isna(c) else c
                if c is None or c != conv or not turns:
                    end()
                    conv, turns = c, []
                turns.append((role, text))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        end()
        if out:
            yield pd.DataFrame(out, columns=names)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that stand alone are spread
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    rows = rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "turn", "role", "text")
    # ids as text: pandas would make a column with a null one of floating point
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")
    out = rows.mapInPandas(run, schema.replace(f"conv_id {kind}", "conv_id string", 1))
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def digests(formatted: DataFrame, read: Callable[[str], list[Turn] | None] = read_inst) -> DataFrame:
    """What ``read`` finds in the formatted texts: number and digest of the turns, and what is under the loss mask; null where the output doesn't give them back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for pdf in batches:
            out = []
            for conv, text, faithful in zip(pdf["conv_id"], pdf["formatted"], pdf["faithful"]):
                found = read(text) if faithful else None
                if found is None:
                    out.append((conv, None, None, None, None, len(text)))
                    continue
                turns = hashlib.sha256()
                for role, content in found:
                    turns.update(f"{role}\n{content}\n".encode())
                loss = "".join(content for role, content in found if role == "assistant")
                out.append((conv, len(found), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            made = pd.DataFrame(out, columns=names)
            yield made.astype({"n_turns": "Int64", "loss_chars": "Int64"})

    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "faithful")
    out = rows.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
