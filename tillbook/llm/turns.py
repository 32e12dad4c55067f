"""Conversation repair: the cheapest edits that give a conversation its shape, and of these the least in letters.

A conversation has its shape if the initials of its roles read ``(s?(ua)+)?``.
A row may be kept (K), given the role user or assistant (R) or deleted (D), and
an empty row may be inserted anywhere (I); blank and repeated rows must go.

The edits are paths through a graph whose nodes are (rows done, state of the
shape, letters written). An edge weighs one integer: its cost in the high
digits, and in the low ones its letter at the place it is written. There are as
many low digits as any path can need, and places not reached stay zero, so a
string that ends comes before one that goes on. The least sum is the cheapest
repair, and among the cheapest the first in the order of letters; nothing else
is compared.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any
length is cut into segments of at most ``ROWS_IN_SEGMENT`` rows. Most
conversations are one segment and are done at once. Of a longer one, every
segment gives the least path from each state to each, these are joined in
order, and the letters go back to the segments. Joining is exact: the cheapest
repair inserts nothing (an inserted row and a neighbour can go instead, for 2
or 4 against at least 5), so paths that can be part of it write a letter a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.session import cut_lineage

ROWS_IN_SEGMENT = 256
# Characters after which a segment is closed.
CHARS_IN_SEGMENT = 1 << 22

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
_STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_DONE = (START, ASSISTANT)
_LETTERS = "\0DIKR"
_CODE = {letter: i for i, letter in enumerate(_LETTERS)}
_BITS = 3
# Two states' cheapest completions differ by no more: two inserts, and a deletion in place of a row kept.
_SLACK = 2 * INSERT + DELETE
_ROLES = {"u": "user", "a": "assistant"}
_SPACE = " \t\n\v\f\r"
FAULTS = ("blank", "duplicate", "truncated")
_LONG = (1 << 63) - 1


def fault_of(role: str, text: str, seen_before: bool) -> str | None:
    """The first fault of a row."""
    seen = text.rstrip(_SPACE)
    if not seen:
        return "blank"
    return "duplicate" if seen_before else None if seen[-1] in ".!?" else "truncated"


def is_illegal(before: str, role: str) -> bool:
    return before[:1] + role[:1] not in ("su", "ua", "au")


def least_paths(rows: list[tuple[str, str | None]], begin: int) -> dict[int, tuple[int, str]]:
    """(cost, letters) of the least path over rows of (role, fault) from one state to each that it can reach cheaply enough."""
    n = len(rows)
    # a node that stays costs at most 2 a row and the slack, so this many inserts are the most
    width = n + (DELETE * n + _SLACK) // INSERT + 1
    places = [1 << (_BITS * (width - 1 - p)) for p in range(width)]
    one = 1 << (_BITS * width)
    nodes = {(begin, 0): 0}
    for i in range(n + 1):
        # inserts before row i, or at the end
        fresh = nodes
        while fresh:
            further: dict[tuple[int, int], int] = {}
            limit = (min(nodes.values()) // one + _SLACK - INSERT + 1) * one
            for (state, place), value in fresh.items():
                if value < limit:
                    for initial in "ua":
                        to = _STEP.get((state, initial))
                        if to is not None:
                            total = value + INSERT * one + _CODE["I"] * places[place]
                            node = (to, place + 1)
                            if total < nodes.get(node, math.inf) and total < further.get(node, math.inf):
                                further[node] = total
            if further:
                nodes = {**nodes, **further}
            fresh = further
        if i == n:
            break
        role, fault = rows[i]
        after: dict[tuple[int, int], int] = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for (state, place), value in nodes.items():
            at = places[place]
            edges = [(state, DELETE * one + _CODE["D"] * at)]
            if fault is None or fault == "truncated":
                to = _STEP.get((state, role[:1]))
                if to is not None:
                    edges.append((to, (KEEP + extra) * one + _CODE["K"] * at))
                for initial in "ua":
                    to = _STEP.get((state, initial))
                    if to is not None:
                        edges.append((to, (REROLE + extra) * one + _CODE["R"] * at))
            for to, weight in edges:
                node, total = (to, place + 1), value + weight
                if total < after.get(node, math.inf):
                    after[node] = total
        limit = (min(after.values()) // one + _SLACK + 1) * one
        nodes = {node: value for node, value in after.items() if value < limit}
    out: dict[int, int] = {}
    for (state, _), value in nodes.items():
        if value < out.get(state, math.inf):
            out[state] = value
    return {state: (value // one, _letters(value % one, width)) for state, value in out.items()}


def _letters(digits: int, width: int) -> str:
    return "".join(_LETTERS[digits >> (_BITS * (width - 1 - p)) & 7] for p in range(width)).rstrip("\0")


def apply(rows: list[tuple[str, str]], letters: str, state: int = START) -> tuple[list[str], int]:
    """``role:text`` of the rows that the edits leave, and the state after them."""
    out, row = [], 0
    for letter in letters:
        if letter == "D":
            row += 1
            continue
        role, text = ("", "") if letter == "I" else rows[row]
        row += letter != "I"
        # at most one of u and a can follow in a state
        initial = role[:1] if letter == "K" else next(c for c in "ua" if (state, c) in _STEP)
        out.append(f"{role if letter == 'K' else _ROLES[initial]}:{text}")
        state = _STEP[state, initial]
    return out, state


def least(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least path to a state in which a conversation may end; deleting all rows leads to one."""
    return min(ends[state] for state in _DONE if state in ends)


def _gaps(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _span(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else min(_LONG, last - first + 1 - distinct)


def repair_rows(rows: list[tuple[int | None, str, str]]) -> dict:
    """A whole conversation of (turn, role, text), in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault_of(role, text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = least(least_paths([(row[1], fault) for row, fault in zip(rows, faults)], START))
    kept, _ = apply([row[1:] for row in rows], audit)
    return {
        "gaps": _span(*_gaps([row[0] for row in rows])), **{f: faults.count(f) for f in FAULTS},
        "illegal": sum(is_illegal(a[1], b[1]) for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired": "\n".join(kept),
    }


# --- over a table -----------------------------------------------------------

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("gaps", *FAULTS, "illegal", "cost")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20 (0 dropped, 1 emptied, 2 without ends of sentences, 3 repeated, 4 the user's).

    Nulls are one space where they are written: in that string, as role, as
    text. Dropped rows stay, with ``gone``, so that no conversation is lost.
    """
    write = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(write("conv_id"), F.lit(":"), write("turn")), "UTF-8")) % 20
    role, text = write("role"), write("text")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, part, seg, whole, turns, roles, texts): runs of a conversation's rows in order; ``whole``: all of it.

    Order: turn, nulls first; rows of one turn by the first 32 characters of the
    role, of the text, then the MD5 of both. Equal rows may change places.
    """
    kind = rows.schema["conv_id"].dataType
    place = ["conv_id", "turn", "_role", "_text", "_both", "_salt"]
    keyed = rows.select(
        "conv_id", "turn", "role", "text", "gone", F.substring("role", 1, 32).alias("_role"), F.substring("text", 1, 32).alias("_text"),
        F.md5(F.encode(F.concat_ws(":", "role", "text"), "UTF-8")).alias("_both"), (F.monotonically_increasing_id() % 1024).alias("_salt"))
    dealt = keyed.repartitionByRange(*place).sortWithinPartitions(*place).select("conv_id", "turn", "role", "text", "gone")
    as_is = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())),
                       ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        numbers = iter(range(1 << 31))
        done: list[dict] = []
        state = {"conv": None, "open": False, "first": True, "cut": False}
        held: list[tuple] = []
        size = 0
        id_type = None

        def close(whole: bool):
            nonlocal size
            done.append({"conv_id": state["conv"], "part": part, "seg": next(numbers), "whole": whole, "turns": [r[0] for r in held],
                         "roles": [r[1] for r in held], "texts": [r[2] for r in held]})
            held.clear()
            size = 0

        def out():
            ids = pa.array([d["conv_id"] for d in done], id_type)
            batch = pa.RecordBatch.from_arrays([ids, *[pa.array([d[f.name] for d in done], f.type) for f in as_is]], ["conv_id", *as_is.names])
            done.clear()
            return batch

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, turn, role, text, gone in zip(*[column.to_pylist() for column in batch.columns]):
                if not state["open"] or conv != state["conv"]:
                    if state["open"]:
                        # the first and the last conversation of a part may go on in another
                        close(not state["first"] and not state["cut"])
                        state["first"] = False
                    state.update(conv=conv, open=True, cut=False)
                if gone:
                    continue
                if len(held) == ROWS_IN_SEGMENT or size > CHARS_IN_SEGMENT:
                    close(False)
                    state["cut"] = True
                held.append((turn, role, text))
                size += len(text)
                if len(done) >= 1000:
                    yield out()
            if done:
                yield out()
        if state["open"]:
            close(False)
            yield out()

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, part int, seg int, whole boolean, turns array<long>, roles array<string>, texts array<string>")


def _per_row(df: DataFrame, function, names: list[str], schema: str) -> DataFrame:
    """``names`` of every row, and the columns of ``schema`` that ``function`` (row as a dict to dict) gives."""
    kept = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    made = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(row) for row in batch.to_pylist()]
            columns = [*[batch.column(n) for n in names], *[pa.array([x[n] for x in found], t) for n, t in made]]
            yield pa.RecordBatch.from_arrays(columns, [*names, *[n for n, _ in made]])

    return df.mapInArrow(run, f"{kept}, {schema}")


def _finish(row: dict) -> dict:
    found = repair_rows(list(zip(row["turns"], row["roles"], row["texts"])))
    return {**found, "repaired_sha256": hashlib.sha256(found["repaired"].encode("utf-8", "surrogatepass")).hexdigest()}


_ENDS = "array<struct<begin int, end int, cost long, letters string>>"
_SUMMARY = f"""first_turn long, last_turn long, distinct_turns long, blank long, duplicate long, truncated long, illegal long,
    first_role string, last_role string, ends {_ENDS}"""


def _summary(row: dict) -> dict:
    roles, firsts = row["roles"], set(row["firsts"] or ())
    faults = [fault_of(role, text, i not in firsts) for i, (role, text) in enumerate(zip(roles, row["texts"]))]
    first, last, distinct = _gaps(row["turns"])
    ends = [
        {"begin": begin, "end": end, "cost": cost, "letters": letters}
        for begin in range(4) for end, (cost, letters) in least_paths(list(zip(roles, faults)), begin).items()]
    return {
        "first_turn": first, "last_turn": last, "distinct_turns": distinct, **{f: faults.count(f) for f in FAULTS},
        "illegal": sum(map(is_illegal, roles, roles[1:])), "first_role": roles[0] if roles else None,
        "last_role": roles[-1] if roles else None, "ends": ends,
    }


def _join(parts: list[dict]) -> tuple[dict, list[tuple[int, str]]]:
    """Counts of a conversation from its segments in order, and of each the state before it and its letters.

    Least paths to the states are ranked by their letters; cost, rank and the next letters make one order again.
    """
    counts = dict.fromkeys(_COUNTS, 0)
    first = last = before = None
    distinct = 0
    best, back = {START: (0, 0)}, []
    for part in parts:
        for f in FAULTS:
            counts[f] += part[f]
        counts["illegal"] += part["illegal"]
        if part["first_role"] is not None:
            counts["illegal"] += before is not None and is_illegal(before, part["first_role"])
            before = part["last_role"]
        if part["first_turn"] is not None:
            distinct += part["distinct_turns"] - (last == part["first_turn"])
            first = part["first_turn"] if first is None else first
            last = part["last_turn"]
        found: dict[int, tuple] = {}
        for x in part["ends"]:
            if x["begin"] in best:
                cost, rank = best[x["begin"]]
                path = (cost + x["cost"], rank, x["letters"], x["begin"])
                if x["end"] not in found or path < found[x["end"]]:
                    found[x["end"]] = path
        order = sorted({path[1:3] for path in found.values()})
        best = {end: (path[0], order.index(path[1:3])) for end, path in found.items()}
        back.append(found)
    state = min((s for s in _DONE if s in best), key=best.get)
    counts["cost"] = best[state][0]
    counts["gaps"] = _span(first, last, distinct)
    chosen = []
    for found in reversed(back):
        _, _, letters, begin = found[state]
        chosen.append((begin, letters))
        state = begin
    return counts, chosen[::-1]


def _by_conversation(df: DataFrame, one, schema: str) -> DataFrame:
    """Groups of ``df`` by conversation, in order of (part, seg); ``one`` makes the rows of a group from its rows, lazily read."""
    from itertools import groupby

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    made = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]
    dealt = df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 16) for row in batch.slice(at, 16).to_pylist())
        for _, group in groupby(rows, key=lambda row: row["conv_id"]):
            found = one(group)
            for at in range(0, len(found), 1000):
                piece = found[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in piece], t) for n, t in made], [n for n, _ in made])

    return dealt.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, gone): counts, the edits' letters, SHA-256 of what they leave.

    ``gone`` rows count for nothing but their conversation's being there; one
    without other rows has zeros, no letters and the hash of an empty string.
    Rows of the null conversation are one conversation. Gaps beyond a long are
    given as the greatest one. Equal rows are repeated ones; an empty table
    gives no rows. The hash is of the whole text, so the texts of a long
    conversation pass one task, a segment at a time.
    """
    cut = cut_lineage(segments(rows))
    at_once = _per_row(cut.where("whole"), _finish, ["conv_id"], RESULT)
    # of equal rows of a conversation the first is none of the repeated ones
    parts = cut.where("not whole").drop("whole")
    place = F.struct("part", "seg", F.col("_at").alias("at"))
    firsts = parts.select("conv_id", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("_at", "_row")).select(
        "conv_id", place.alias("place"), F.sha2(F.to_json("_row"), 256).alias("row"))
    firsts = firsts.groupBy("conv_id", "row").agg(F.min("place").alias("place"))
    firsts = firsts.groupBy("place.part", "place.seg").agg(F.collect_list("place.at").alias("firsts"))
    summed = _per_row(parts.join(firsts, ["part", "seg"], "left"), _summary, ["conv_id", "part", "seg"], _SUMMARY)
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    id_type = cut.schema["conv_id"].dataType.simpleString()

    def choose(group) -> list[dict]:
        own = list(group)
        found, chosen = _join(own)
        return [
            {"part": row["part"], "seg": row["seg"], "begin": begin, "letters": letters, **(found if i == 0 else dict.fromkeys(_COUNTS))}
            for i, (row, (begin, letters)) in enumerate(zip(own, chosen))]

    chosen = _by_conversation(summed, choose, f"part int, seg int, begin int, letters string, {counts}")
    # letters and texts meet by segment, then a conversation's come together in order
    edited = _per_row(
        parts.join(chosen, ["part", "seg"]),
        lambda row: {"kept": "\n".join(left := apply(list(zip(row["roles"], row["texts"])), row["letters"], row["begin"])[0]), "any": bool(left)},
        ["conv_id", "part", "seg", "letters", *_COUNTS], "kept string, any boolean")

    def hashed(group) -> list[dict]:
        digest, begun, letters, found, conv = hashlib.sha256(), False, [], {}, None
        for row in group:
            conv = row["conv_id"]
            if not letters:
                found = {c: row[c] for c in _COUNTS}
            letters.append(row["letters"])
            if row["any"]:
                digest.update(("\n" if begun else "").encode() + row["kept"].encode("utf-8", "surrogatepass"))
                begun = True
        return [{"conv_id": conv, **found, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}]

    joined = _by_conversation(edited, hashed, f"conv_id {id_type}, {RESULT}")
    return at_once.unionByName(joined)
