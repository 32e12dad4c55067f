from __future__ import annotations

import re

from tillbook.llm import secrets

LIVE = "aB3dE6gH9kL2mN5p"
KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)
TEXTS = [
    f"é\U0001f600 my PassWord = '{LIVE}' end", None, "", "token:short secret: token: abcdefghijklmnop", f"api_key={LIVE}{LIVE}",
    "apikey=" * 400 + "abcdefghijklmnop0", "AKIA" + "Z9" * 8 + " AKIAAKIA0 xAKIA123456789012345", "deadbeef" * 4 + "g" + "0" * 15,
    "passwd : \"0123456789abcdef0123456789abcdef\"", "paſſword=abcdefghijklmnop TOKEN=\tabcdefghijklmnop", "secret=" + "x" * 50_000,
]


def brute(text):
    spans = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        spans += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(spans)]


def test_spans_match_another_engine(docs_of):
    docs = docs_of(*enumerate(TEXTS), (0, TEXTS[0]))
    rows = secrets.scan(docs, keep=["doc_id", "spans"]).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute(TEXTS[r.doc_id]), r.doc_id


def test_widely_copied_values_are_examples(docs_of):
    rows = [(i, "token=exampleKey12345", f"src{i}") for i in range(4)] + [(10 + i, f"token={LIVE}", "one") for i in range(5)]
    rows += [(20, "token=aaaaaaaaaaaaaaaa1", "one"), (21, f"secret={LIVE}x", None)]
    live = {r.doc_id: [s.value for s in r.live] for r in secrets.scan(docs_of(*rows), keep=["doc_id"]).collect()}
    assert all(not live[i] for i in (0, 1, 2, 3, 20))
    assert all(live[i] == [LIVE] for i in range(10, 15)) and live[21] == [LIVE + "x"]


def test_redaction_keeps_the_rest(docs_of):
    docs = docs_of((1, f"é token={LIVE} and api_key: 0123456789abcdef0a end"), (2, "clean"), (3, None), (2, "clean"))
    out = secrets.redact(docs, length="n_chars")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "é <secret> and <secret> end" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean" and rows[3].text is None and out.count() == 4
    assert secrets.redact(docs.limit(0)).count() == 0 and secrets.scan(docs.limit(0), keep=["doc_id"]).count() == 0
