import re

from cairn.llm import license_scan
from cairn.llm.license_scan import NOTICES, PHRASES, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for label, phrase in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def check(df):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(df).collect()), key=str)
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_matches_brute_force(small):
    check(small)


def test_odd_rows(docs_of):
    long = "mit license " * 3000 + "General Public LICENSE"
    rows = [(1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (None, "Apache-License é"), (4, long), (5, "license mit licenſe mit\x00license"), (6, "general public\npublic license general public license")]
    check(docs_of(rows))
    check(docs_of(rows, extra=True))
    assert scan(docs_of([])).count() == 0


def test_notices_add_labels(docs_of):
    notice = NOTICES[0][1]
    broken = notice.replace("free of charge", "free of any charge")
    rows = {r.doc_id: r for r in scan(docs_of([(1, notice), (2, "x y " + broken), (3, "the software and the files"), (4, "Released under the MIT license.")])).collect()}
    assert rows[1].labels == "notice-mit" and rows[1].score == 1.0 and rows[1].base_labels == ""
    assert rows[2].labels == "notice-mit" and 0.6 <= rows[2].score <= 1 and rows[2].first_notice == 2
    assert rows[3].labels == "" and rows[3].score == 0
    assert rows[4].labels == "mit,notice-mit" and rows[4].base_labels == "mit" and rows[4].first_word == 3


def test_more_templates_than_a_broadcast_holds(docs_of, small, monkeypatch):
    rows = [(1, None), (2, "x"), (3, NOTICES[0][1] + " mit license"), (3, "mit license"), (None, "Released under the MIT license."), (4, "a b " * 2000)]
    many = [*NOTICES, *((f"notice-{i}", f"word{i} of licence number {i} that nobody has") for i in range(200))]
    for df in (docs_of(rows), small):
        want = sorted(map(tuple, scan(df, notices=many).collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(license_scan, "MAX_TEMPLATE_WORDS", 10)
            got = scan(df, notices=many)
            assert sorted(map(tuple, got.collect()), key=str) == want
            assert "hash" in str(got._jdf.queryExecution().optimizedPlan()) and len(want) == df.count()
