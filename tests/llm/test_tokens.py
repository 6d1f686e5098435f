import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Regex, Tokenizer, pre_tokenizers

from cairn.llm.packing import pack, places, plan
from cairn.llm.tokens import SPLIT, Encoder, balanced, count_tokens, default_vocabulary

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENC = Encoder(*default_vocabulary())
TEXT = st.text(st.one_of(st.sampled_from(" \t\n\r\x85\xa0\u2003'’aZé9²½ªİſ中🙂\x1c\x00"), st.characters(exclude_categories=['Cs'])), max_size=60)


def lib(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(text):
    assert list(ENC.ids(text)) == lib(text)
    assert ENC.lengths([text, text]).tolist() == [len(lib(text))] * 2


def test_both_libraries_have_the_same_classes_of_all_characters():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding("probe", pat_str=kind + "+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        fast = set(probe.decode_bytes(probe.encode_ordinary(every)).decode())
        exact = {c for x, _ in pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(every) for c in x}
        assert fast == exact and len(fast) > 20


def test_every_character_of_some_blocks():
    for c in map(chr, [*range(0x600), *range(0x2000, 0x2070), *range(0x4E00, 0x4E80), 0x20AC, 0x1F600]):
        text = f"a{c}b {c} {c}{c}9{c}\n{c}  {c}x"
        assert list(ENC.ids(text)) == lib(text), hex(ord(c))


LONG = {
    "ascii": "word Another, x1 it's  y\n" * 20000,
    "cyrillic": "слово другое,это же " * 20000,
    "cyrillic without spaces": "словодругоеэтоже" * 20000,
    "chinese": "中文沒有空格的長文本。" * 30000,
    "arabic": "كلمةأخرى٣٤هنا" * 20000,
    "digits": "0123456789" * 30000,
    "code": "f(x)=a[i]->b'c;'s''ll" * 15000,
    "one letter": "x" * 300000,
    "spaces": " " * 200000 + "a" + "\n" * 100000,
    "special": "<|endoftext|> word中" * 20000,
    "emoji": "🙂🙃" * 60000,
}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts_and_special_strings(kind):
    text = LONG[kind]
    assert list(ENC.ids(text)) == lib(text) and "".join(ENC.parts(text)) == text
    assert ENC.lengths([text, "", "a"]).tolist() == [len(lib(text)), 0, 1]
    if kind not in ("one letter", "digits", "spaces"):
        assert max(map(len, ENC.parts(text))) < 2 * SPLIT


WHITE = {"spaces": " ", "newlines": "\n", "tabs": "\t", "mixed": "\n  \t\r", "no-break": "\xa0", "wide": "\u2003 "}


def same(text):
    want = lib(text)
    return ENC.ids(text).tolist() == want and ENC.lengths([text, "a"]).tolist() == [len(want), 1]


@pytest.mark.parametrize("kind", WHITE)
def test_long_white_space(kind):
    unit = WHITE[kind]
    for n in (SPLIT - 2, SPLIT - 1, SPLIT, SPLIT + 1, 200_000):
        run = (unit * n)[:n]
        for text in (run, f"x{run}", f"{run}y", f"x{run}y z", f"x{run}<|endoftext|>{run}'s", f"1{run}.{run}é"):
            assert same(text), (kind, n, text[:1], text[-1:])
    n = 5_000_000 if len(unit) == 1 and unit < "\x80" else 1_000_000
    assert same(f"x{(unit * n)[:n]}y")


@pytest.mark.parametrize("byte", " \n\t\r\x0b")
def test_one_byte_repeated(byte):
    for n in (*range(1, 300), 1023, 1025, 70_001):
        assert ENC.repeated(byte.encode(), n).tolist() == lib(byte * n)


def test_white_space_of_a_million_in_tables(docs_of):
    texts = ["x" + "\n" * 1_000_000 + "y", " " * 1_000_000, "\t \n" * 400_000]
    df = docs_of(list(enumerate(texts)))
    assert sorted(r["n_tokens"] for r in count_tokens(df).collect()) == sorted(len(lib(t)) for t in texts)
    packed = pack(df).groupBy("doc_id").sum("length").collect()
    assert sorted(r[1] for r in packed) == sorted(len(lib(t)) + 1 for t in texts)


def test_special_strings():
    for text in ("a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a <|endoftext|>  b", "<|endoftext|"):
        assert list(ENC.ids(text)) == lib(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab '’.,9é中文かк\n\u3000ة🙂"), min_size=30, max_size=80))
def test_cuts_are_safe_everywhere(text):
    for at in range(2, len(text)):
        if cut := ENC.cut(text, at):
            assert lib(text[:cut]) + lib(text[cut:]) == lib(text)


def test_without_a_rank_file():
    slow = Encoder(default_vocabulary()[0], None)
    for text in ("a <|endoftext|> it's", "", "中文 x"):
        assert list(slow.ids(text)) == lib(text) and slow.lengths([text]).tolist() == [len(lib(text))]


def test_memory_of_long_texts_in_any_script():
    """A worker that counts and encodes two million characters without spaces stays under 200 MB."""
    code = (
        "from cairn.llm.tokens import *; e = Encoder(*default_vocabulary());"
        "t = 'словодругое中文' * 150000; n = int(e.lengths([t])[0]); assert len(e.ids(t)) == n;"
        "print(next(x.split()[1] for x in open('/proc/self/status') if x.startswith('VmHWM')))"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(out.stdout) < 200_000


def test_balanced():
    assert [(s.start, s.stop) for s in balanced(np.array([5, 1, 1, 9, 1]), 6)] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(balanced(np.array([], int))) == []


def test_counts(docs_of, small):
    rows = [(1, None), (2, ""), (2, "é" * 600), (None, "one two")]
    for df in (docs_of(rows), docs_of(rows, extra=True), small):
        got = sorted(map(tuple, count_tokens(df).collect()), key=str)
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(lib(r.text)), n > 512) for r in df.select("doc_id", "text").collect()), key=str)
        assert got == want
    assert count_tokens(docs_of([])).count() == 0


def check_packed(df, capacity=2048):
    got = [r.asDict() for r in pack(df, capacity).collect()]
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = [*lib(r.text), 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got), key=str) == sorted(want, key=str)
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(x[3] for x in want)


def test_pack(docs_of, small):
    n, total = check_packed(small)
    assert n <= 1.02 * -(-total // 2048) + 1
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 5000)] + [(i, "same text") for i in range(10, 200)]
    check_packed(docs_of(rows))
    check_packed(docs_of(rows, extra=True), 16)
    assert pack(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_plan_places_all(counts):
    patterns = plan(counts, 30)
    used = {}
    for times, items in patterns:
        assert times > 0 and sum(items) <= 30
        for s in items:
            used[s] = used.get(s, 0) + times
    assert used == counts
    rows = places(patterns)
    for s, n in counts.items():
        assert sorted((a, b) for x, a, b, _, _ in rows if x == s)[-1][1] == n


def plain_best_two_fit(counts, capacity):
    """Bin after bin, piece after piece: the largest that fits, then two unpacked for the smallest."""
    left = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    bins = []
    while left:
        gap, own = capacity, []
        for s in list(left):
            if s <= gap:
                own.append(s)
                left.remove(s)
                gap -= s
        if gap and len(own) > 1:
            room = gap + own[-1]
            pairs = [(left[i] + left[j], -left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if own[-1] < left[i] + left[j] <= room]
            if pairs:
                *_, a, b = max(pairs)
                left.append(own.pop())
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
                own += [a, b]
        bins.append(own)
    return bins


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 12), max_size=9), st.integers(24, 40))
def test_plan_is_best_two_fit(counts, capacity):
    got = [sorted(items) for times, items in plan(counts, capacity) for _ in range(times)]
    assert got == [sorted(x) for x in plain_best_two_fit(counts, capacity)]


def test_two_replace_the_smallest():
    # greedy takes 6 and 3 and leaves a gap of 1; 2 and 2 fill the widened gap of 4
    assert plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
