from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.conftest import SF
from tillbook.llm import queries, turns

SHAPE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """The contract's damage to (conv, turn, role, text), as plain Python; conversations in a dict."""
    out: dict = {}
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        mine = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        if kind:
            mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32], hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    return out


def faults_of(rows):
    found, seen = [], set()
    for _, role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        found.append("blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def by_all_edits(rows, inserts):
    """Every way to edit the rows with up to so many inserts: the least (cost, letters), and what is left."""
    faults, ways = faults_of(rows), []
    for n in range(inserts + 1):
        for where in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            slots = sorted([(i, 1, i) for i in range(len(rows))] + [(w, 0, None) for w in where], key=lambda x: x[:2])
            choices = []
            for _, _, i in slots:
                if i is None:
                    choices.append([(5, "I", r, "") for r in ("user", "assistant")])
                    continue
                _, role, text = rows[i]
                options = [(2, "D", None, None)]
                if faults[i] in (None, "truncated"):
                    add = 5 if faults[i] else 0
                    options += [(add, "K", role, text), (1 + add, "R", "user", text), (1 + add, "R", "assistant", text)]
                choices.append(options)
            for way in itertools.product(*choices):
                left = [(r, t) for _, _, r, t in way if r is not None]
                if SHAPE.fullmatch("".join(r[:1] or "?" for r, _ in left)):
                    ways.append((sum(c for c, *_ in way), "".join(x for _, x, *_ in way), "\n".join(f"{r}:{t}" for r, t in left)))
    return min(ways)


def by_states(rows):
    """The least (cost, letters) with deletions, keeping and new roles only, one row after the other, and what is left."""
    step = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    ends = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults_of(rows)):
        after: dict = {}
        for state, (cost, letters, left) in ends.items():
            ways = [(state, (cost + 2, letters + "D", left))]
            if fault in (None, "truncated"):
                add = 5 if fault else 0
                for letter, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    to = step.get(new[:1], {}).get(state)
                    if to:
                        ways.append((to, (cost + price + add, letters + letter, (*left, f"{new}:{text}"))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way)
        ends = after
    cost, letters, left = min(ends[x] for x in ("", "a") if x in ends)
    return cost, letters, "\n".join(left)


def expected(rows, edits):
    faults = faults_of(rows)
    known = sorted(t for t, *_ in rows if t is not None)
    cost, audit, left = edits(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest())


def random_rows(rnd, n):
    roles = ["user", "assistant", "system", "tool", "", " ", "agent", "unit"]
    texts = ["", " \t", "a.", "b!", "c", "d? ", "é.", "x\n", "a."]
    weights = [6, 6, 2, 1, 1, 1, 1, 1]
    return [(rnd.choice([None, *range(n + 1)]), rnd.choices(roles, weights)[0], rnd.choice(texts)) for _ in range(n)]


def test_against_all_edits():
    rnd = random.Random(5)
    for trial in range(150):
        rows = [(i, *r[1:]) for i, r in enumerate(random_rows(rnd, rnd.randrange(5)))]
        found = turns.repair_rows(rows)
        assert (found["cost"], found["audit"], found["repaired"]) == by_all_edits(rows, 2) == by_states(rows), rows


def test_inserts_are_weighed(monkeypatch):
    """With dearer deletions the cheapest repair inserts, and a shorter string of letters comes first."""
    monkeypatch.setattr(turns, "DELETE", 50)
    monkeypatch.setattr(turns, "_SLACK", 60)
    assert turns.repair_rows([(0, "user", "a."), (1, "user", "b.")])["audit"] == "KR"
    found = turns.repair_rows([(0, "user", "a."), (1, "assistant", "b."), (2, "user", "c.")])
    assert (found["audit"], found["cost"], found["repaired"]) == ("KKKI", 5, "user:a.\nassistant:b.\nuser:c.\nassistant:")
    assert turns.repair_rows([(0, "system", "a.")])["audit"] == "IR"


@pytest.mark.parametrize("size", [1, 2, 7])
def test_segments_join_to_the_same(size):
    rnd = random.Random(size)
    for _ in range(60):
        rows = [(i // 2, *r[1:]) for i, r in enumerate(random_rows(rnd, rnd.randrange(40)))]
        seen, parts = set(), []
        for at in range(0, max(1, len(rows)), size):
            piece = rows[at : at + size]
            firsts = [i for i, r in enumerate(piece) if not (r[1:] in seen or seen.add(r[1:]))]
            parts.append(turns._summary({"turns": [r[0] for r in piece], "roles": [r[1] for r in piece], "texts": [r[2] for r in piece], "firsts": firsts}))
        counts, chosen = turns._join(parts)
        whole = turns.repair_rows(rows)
        assert counts == {c: whole[c] for c in counts} and "".join(x for _, x in chosen) == whole["audit"]


def found_by_query(spark, folder):
    rows = queries.QUERIES["op12_turn_repair"](spark, folder).collect()
    return {r.conv_id: tuple(r[c] for c in "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()) for r in rows}, len(rows)


def test_registered_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: expected(mine, by_states) for conv, mine in damaged(rows).items()}
    found, n = found_by_query(spark, SF)
    assert found == want and n == len(want) > 10


@pytest.mark.parametrize("in_segment", [256, 3])
def test_registered_query_on_odd_rows(spark, tmp_path, monkeypatch, in_segment):
    """Nulls in any column, ties, repeated rows, one long conversation, conversations without rows left, clashing columns."""
    monkeypatch.setattr(turns, "ROWS_IN_SEGMENT", in_segment)
    rnd = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        rows += [(conv, *r) for r in random_rows(rnd, rnd.randrange(9))]
    rows += [(1000, i, rnd.choice(["user", "assistant", "system"]), f"t{rnd.randrange(300)}{rnd.choice('.!? x')}") for i in range(900)]
    rows += [(2000, None, "user", "same.")] * 300 + [(3, 1, None, None), (None, None, None, None), (4, 7, "user", "word " * 50_000 + ".")]
    rows += [(5000 + i, 0, "user", "only.") for i in range(60)]
    schema = "conv_id long, turn long, role string, text string, part string, seg int, whole string, roles string, gone string, cost string"
    table = spark.createDataFrame([(*r, "x", 1, "x", "x", "x", "x") for r in rows], schema)
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {conv: expected(mine, by_states) for conv, mine in damaged(rows).items()}
    found, n = found_by_query(spark, str(tmp_path))
    assert found == want and n == len(want)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert any(damaged(rows)[c] == [] and found[c] == empty for c in found)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert found_by_query(spark, str(tmp_path)) == ({}, 0)
