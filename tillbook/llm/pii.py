"""Personal data by a semi-Markov CRF over whole texts.

Four base patterns give the spans that can be told by form alone; these always
stay. The CRF finds what they miss (other phone forms, spoken addresses, shorter
cards). It cuts a text into segments, each outside (one token) or one entity (up to
``MOST_TOKENS`` tokens), and scores whole segments: form, checks on the digits,
words before, base matches, and the label before. The best segmentation is found
by dynamic programming over segment ends.

A segment can be an entity only if it has the form of one (``_number_kinds``,
``_ADDRESS``) or is a base match. All others score minus infinity, so tokens that
are in no such segment are outside in every segmentation, and the programme runs
over the stretches between them: the result is that of the whole text.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone")
# Longest entity: tokens and characters. A base match is a possible segment of any length.
MOST_TOKENS = 32
MOST_CHARS = 254

# Patterns of the contract, fixed values. Possessive where the next character decides anyway, so that they run in
# linear time; the e-mail's local part is found from its @ on.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(digits: str) -> bool:
    """At most 255; leading zeros don't count."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") < 256


def _is_ip(text: str) -> bool:
    return all(map(_small, text.split(".")))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every match of the base patterns, kinds in the order of ``KINDS``, then by start.

    Matches of one kind are leftmost and don't overlap; one that fails its check (parts, digits, Luhn) goes without a
    second try. Matches of different kinds may overlap.
    """
    found = []
    done, before, at = 0, 0, text.find("@")
    while at >= 0:
        # what a search for local part, @ and domain finds, without trying every start of the local part
        start = max(done, before)
        run = at
        while run > start and text[run - 1] in _LOCAL:
            run -= 1
        domain = _DOMAIN.match(text, at + 1) if run < at else None
        if domain:
            found.append((0, run, domain.end()))
            done = domain.end()
        before = at + 1
        at = text.find("@", max(at + 1, done))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _is_ip(m.group())]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _only_digits(m.group())) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return [(a, b, KINDS[k]) for k, a, b in found]


# --- possible segments ------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|.", re.S)
_AT = r"(?: ?@ ?| ?[\[({<] ?at ?[\])}>] ?| at )"
_DOT = r"(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )"
_PART = "[A-Za-z0-9_%+-]++"
_ADDRESS = re.compile(rf"{_PART}(?:{_DOT}{_PART})*{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I)
_AT_MARK = re.compile(r"@|[\[({<] ?[aA][tT] ?[\])}>]|[dD][oO][tT](?![A-Za-z0-9])(?<![A-Za-z0-9]...)")
_NUMBERS = re.compile(r"[0-9](?<![A-Za-z0-9][0-9])[0-9]*+(?![A-Za-z])(?:[ +()./-]{1,3}[0-9]++(?![A-Za-z]))*")
_NUMBER_FORM = re.compile(r"\+?\(?[0-9]+(?:(?:[ ./-]| - |\)[ ./-]?| ?\()[0-9]+)*")
_DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


def _number_kinds(segment: str) -> tuple[int, ...]:
    """Kinds, by number, whose form a stretch of digits and separators has."""
    if not _NUMBER_FORM.fullmatch(segment):
        return ()
    digits = sum("0" <= c <= "9" for c in segment)
    out = [1] if _DOTTED.fullmatch(segment) else []
    if 12 <= digits <= 19 and not set(segment) & set("+()/"):
        out.append(2)
    if 7 <= digits <= 15:
        out.append(3)
    return tuple(out)


def _stretches(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Disjoint stretches of the text outside of which no token is in a possible segment, cut between tokens."""
    found = [(a, b) for a, b, _ in base]
    for m in _NUMBERS.finditer(text):
        a = m.start()
        while a > m.start() - 3 and a > 0 and text[a - 1] in "+( ":
            a -= 1
        found.append((a, m.end()))
    for m in _AT_MARK.finditer(text):
        found.append((max(0, m.start() - MOST_CHARS), min(len(text), m.end() + MOST_CHARS)))
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cuts(text: str, a: int, b: int, base) -> list[int]:
    """Ends of tokens from a to b, also where base matches begin and end. Half tokens at the ends stay out of segments."""
    cuts = {a, b}
    for m in _TOKEN.finditer(text, a, b):
        cuts.add(m.end())
    for x, y, _ in base:
        if x >= a and y <= b:
            cuts |= {x, y}
    return sorted(cuts)


def _arcs(text: str, cuts: list[int], base) -> list[tuple[int, int, int]]:
    """(first cut, last cut, kind) of every segment that may be an entity, by last cut."""
    own = {(x, y, KINDS.index(k)) for x, y, k in base if cuts[0] <= x and y <= cuts[-1]}
    place = {c: i for i, c in enumerate(cuts)}
    out = {(place[x], place[y], k) for x, y, k in own}
    n = len(cuts) - 1
    alnum = lambda at: text[at].isascii() and text[at].isalnum()
    # a segment ends where words end and begins where they begin
    ends = [j > 0 and alnum(cuts[j] - 1) and (cuts[j] == len(text) or not alnum(cuts[j])) for j in range(n + 1)]
    begins = [cuts[i] == 0 or not alnum(cuts[i] - 1) or not alnum(cuts[i]) for i in range(n)]
    # tokens that no number can hold, and the places of @ or what is written for it; an address has a mark that is no plain word
    digits_of = [sum("0" <= c <= "9" for c in text[cuts[i] : cuts[i + 1]]) for i in range(n)]
    breaks = [not all(c in "0123456789+()./- " for c in text[cuts[i] : cuts[i + 1]]) or cuts[i + 1] - cuts[i] > 1 and text[cuts[i]] == " " for i in range(n)]
    marks = [m.start() for m in _AT_MARK.finditer(text, cuts[0], cuts[-1])]
    spoken = [m.start() for m in re.finditer(r" [aA][tT] ", text[cuts[0] : cuts[-1]])] if marks else []
    ats = sorted({m for m in marks if text[m] not in "dD"} | {cuts[0] + m for m in spoken})
    for i in range(n):
        first = text[cuts[i]]
        if not begins[i]:
            continue
        if first in "+(" or "0" <= first <= "9":
            digits = 0
            for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
                if breaks[j - 1]:
                    break
                digits += digits_of[j - 1]
                if digits > 19:
                    break
                if ends[j] and (digits >= 7 or digits >= 4 and text.count(".", cuts[i], cuts[j]) == 3):
                    out |= {(i, j, k) for k in _number_kinds(text[cuts[i] : cuts[j]])}
        if ats and (alnum(cuts[i]) or first in "_%+-"):
            next_at = bisect_left(ats, cuts[i])
            if next_at < len(ats) and ats[next_at] - cuts[i] <= MOST_CHARS:
                for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
                    if cuts[j] - cuts[i] > MOST_CHARS:
                        break
                    if ends[j] and cuts[j] > ats[next_at] and _ADDRESS.fullmatch(text, cuts[i], cuts[j]) and _AT_MARK.search(text, cuts[i], cuts[j]):
                        out.add((i, j, 0))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


# --- features -------------------------------------------------------------

CUES = {
    "email": set("mail email e-mail write contact address courriel correo schreiben".split()),
    "ip": set("ip host server from address login client adresse".split()),
    "card": set("card visa mastercard amex pay credit karte carte tarjeta paid".split()),
    "phone": set("phone tel call fax mobile telefon ring telefono téléphone móvil".split()),
    "other": set("version release order invoice isbn nr number section chapter ref serial build".split()),
}
_WORD_BEFORE = re.compile(r"([^\W\d_][\w-]*)\W*$")
_ON = re.compile(rf"(?:{_DOT}|{_AT})[A-Za-z0-9]", re.I)
_BEFORE = re.compile(rf"[A-Za-z0-9](?:{_DOT}|{_AT})$", re.I)
_DATE = re.compile(r"(?:[0-9]{4}([-./ ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./ ])[0-9]{1,2}\2[0-9]{4})(?: ?[-/] ?.*)?")
_NAMES = (
    *(f"{k}:bias" for k in KINDS), *(f"{k}:base" for k in KINDS), *(f"{k}:cue" for k in KINDS), *(f"{k}:other cue" for k in KINDS),
    *(f"{k}:cut" for k in KINDS), "email:mark", "email:spoken", "email:spaced", "email:ending", "ip:range", "ip:zero",
    "card:luhn", "card:even", "card:mixed", "card:length", "phone:plus", "phone:paren", "phone:length", "phone:short", "phone:bare",
    "phone:one", "phone:groups", "phone:date", "phone:last", "phone:trunk", "after:same", "after:other",
)
FEATURES = {name: i for i, name in enumerate(_NAMES)}


def _features(text: str, a: int, b: int, kind: int, is_base: bool) -> list[int]:
    segment, name = text[a:b], KINDS[kind]
    out = [f"{name}:bias"]
    if is_base:
        out.append(f"{name}:base")
    word = _WORD_BEFORE.search(text[max(0, a - 24) : a])
    word = word.group(1).lower() if word else ""
    if word in CUES[name]:
        out.append(f"{name}:cue")
    elif word in CUES["other"]:
        out.append(f"{name}:other cue")
    # goes on before or after: a part of something longer
    if re.match(r"[-./@_+%][A-Za-z0-9]", text[b : b + 2]) or re.search(r"[A-Za-z0-9][-./@_+%]$", text[max(0, a - 2) : a]):
        out.append(f"{name}:cut")
    elif kind == 0 and (_ON.match(text, b, b + 16) or _BEFORE.search(text[max(0, a - 16) : a])):
        out.append("email:cut")
    groups = re.findall("[0-9]+", segment)
    digits = "".join(groups)
    if kind == 0:
        out.append("email:mark" if "@" in segment or re.search(r"[\[({<] ?at", segment, re.I) else "email:spoken")
        if " " in segment:
            out.append("email:spaced")
        if re.search(r"[^A-Za-z0-9][A-Za-z]{2,6}$", segment):
            out.append("email:ending")
    elif kind == 1:
        if all(map(_small, groups)):
            out.append("ip:range")
        if any(len(g) > 1 and g[0] == "0" for g in groups):
            out.append("ip:zero")
    elif kind == 2:
        if luhn(digits):
            out.append("card:luhn")
        if len(groups) == 1 or [len(g) for g in groups] in ([4, 4, 4, 4], [4, 6, 5]):
            out.append("card:even")
        if len(set(re.sub("[0-9]", "", segment))) > 1:
            out.append("card:mixed")
        if len(digits) in (13, 14, 15, 16, 19):
            out.append("card:length")
    else:
        out += [f"phone:{x}" for x, has in (
            ("plus", segment[0] == "+"), ("paren", "(" in segment), ("length", 10 <= len(digits) <= 13), ("short", len(digits) < 8),
            ("bare", len(groups) == 1 and segment[0] != "+"), ("one", min(map(len, groups)) == 1 and segment[0] != "+"), ("groups", 3 <= len(groups) <= 6),
            ("date", bool(_DATE.fullmatch(segment))), ("last", len(groups[-1]) == 4), ("trunk", segment[0] == "0" and 9 <= len(digits) <= 11)) if has]
    return [FEATURES[x] for x in out]


class Lattice:
    """Possible segments of one stretch, with their features."""

    def __init__(self, text: str, a: int, b: int, base):
        self.cuts = _cuts(text, a, b, base)
        self.arcs = _arcs(text, self.cuts, base)
        known = set(base)
        self.features = [
            _features(text, self.cuts[i], self.cuts[j], k, (self.cuts[i], self.cuts[j], KINDS[k]) in known) for i, j, k in self.arcs]

    def best(self, weights) -> list[tuple[int, int, str]]:
        """The entities of the best segmentation; of equal ones, that with an outside token, then the longer segment."""
        if not self.arcs:
            return []
        same, other = weights[FEATURES["after:same"]], weights[FEATURES["after:other"]]
        n, outside = len(self.cuts) - 1, len(KINDS)
        # by end and last label: the score, the segment's begin and the label before
        top: list[list[tuple]] = [[(-math.inf, 0, 0)] * (outside + 1) for _ in range(n + 1)]
        top[0][outside] = (0.0, -1, -1)
        arc = 0
        for end in range(1, n + 1):
            before = top[end - 1]
            label = max(range(outside, -1, -1), key=lambda x: before[x][0])
            top[end][outside] = (before[label][0], end - 1, label)
            while arc < len(self.arcs) and self.arcs[arc][1] == end:
                begin, _, kind = self.arcs[arc]
                score = sum(weights[f] for f in self.features[arc])
                for label in range(outside, -1, -1):
                    total = top[begin][label][0] + score + (0.0 if label == outside else same if label == kind else other)
                    if total > top[end][kind][0]:
                        top[end][kind] = (total, begin, label)
                arc += 1
        end, label = n, max(range(outside, -1, -1), key=lambda x: top[n][x][0])
        out = []
        while end > 0:
            _, begin, prior = top[end][label]
            if label != outside:
                out.append((self.cuts[begin], self.cuts[end], KINDS[label]))
            end, label = begin, prior
        return out[::-1]


def entities(text: str, base=None, weights=None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities in the best segmentation of the whole text."""
    base = base_spans(text) if base is None else base
    weights = WEIGHTS if weights is None else weights
    return [span for a, b in _stretches(text, base) for span in Lattice(text, a, b, [x for x in base if a <= x[0] and x[1] <= b]).best(weights)]


def all_spans(base: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base matches, and the entities found that overlap none of them; kinds in the order of ``KINDS``, then by start."""
    taken: list[list[int]] = []
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    free = [x for x in found if (at := bisect_left(starts, x[1])) == 0 or taken[at - 1][1] <= x[0]]
    return sorted({*base, *free}, key=lambda x: (KINDS.index(x[2]), x[0]))


# --- weights ----------------------------------------------------------------


def _checked(rnd, digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _digits(rnd, n: int) -> str:
    return "".join(rnd.choice("0123456789") for _ in range(n))


def _word(rnd) -> str:
    return "".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randint(2, 9)))


def _email(rnd) -> str:
    local = rnd.choice(["{a}.{b}", "{a}", "{a}.{n}", "{a}_{b}", "{a}+{b}", "{a}{n}"]).format(a=_word(rnd), b=_word(rnd), n=rnd.randrange(100))
    host = rnd.choice(["{a}.{t}", "{a}{n}.{b}.{t}", "{a}.{b}.{t}"]).format(a=_word(rnd), b=_word(rnd), n=rnd.randrange(10), t=rnd.choice("com org net de fr io info".split()))
    at, dot = rnd.choice([("@", ".")] * 6 + [(" @ ", "."), ("[at]", "."), (" (at) ", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
    return local.replace(".", dot if rnd.random() < 0.5 else ".") + at + host.replace(".", dot)


def _ip(rnd) -> str:
    return ".".join(str(rnd.randrange(256)) for _ in range(4))


def _card(rnd) -> str:
    if rnd.random() < 0.2:
        d = _checked(rnd, rnd.choice(["34", "37"]) + _digits(rnd, 12))
        sep = rnd.choice(["", "", " ", "-"])
        return sep.join((d[:4], d[4:10], d[10:]))
    d = _checked(rnd, rnd.choice("4562") + _digits(rnd, 14))
    return rnd.choice(["", "", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))


def _phone(rnd) -> str:
    form = rnd.choice([
        "+1 (999) 999-9999", "+1 (999) 999-9999", "+1-999-999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "+49 30 9999999", "+44 20 9999 9999",
        "+33 6 99 99 99 99", "+34 999 999 999", "+19999999999", "06 99 99 99 99", "030 9999999", "0170/9999999", "+49(30)9999999"])
    return "".join(rnd.choice("123456789") if c == "9" else c for c in form)


def _other(rnd) -> str:
    """What looks like an entity but is none."""
    kind = rnd.randrange(15)
    if kind < 3:  # a long number that fails the check
        d = _checked(rnd, rnd.choice("123456789") + _digits(rnd, 14))
        return d[:-1] + str((int(d[-1]) + rnd.randint(1, 9)) % 10)
    if kind == 3:
        return ".".join(str(rnd.randint(0, 999)) for _ in range(3)) + f".{rnd.randint(256, 999)}"
    return (
        lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}",
        lambda: f"{rnd.randint(1, 28):02d}.{rnd.randint(1, 12):02d}.{rnd.randint(1900, 2030)}",
        lambda: ".".join(str(rnd.randrange(20)) for _ in range(rnd.choice([2, 3, 5]))),
        lambda: ".".join(f"{rnd.randrange(40):02d}" for _ in range(3)) + f".0{rnd.randrange(10)}",
        lambda: rnd.choice(["version ", "release ", "section "]) + ".".join(str(rnd.randrange(12)) for _ in range(4)),
        lambda: _digits(rnd, rnd.randint(7, 12)),
        lambda: f"{rnd.randint(1, 99)} {rnd.randint(100, 999)} {rnd.randint(100, 999)}",
        lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1900, 2030)}",
        lambda: f"{_word(rnd)} at {_word(rnd)}. {_word(rnd)} dot {_word(rnd)}",
        lambda: f"@{_word(rnd)} and {_word(rnd)} @ {rnd.randrange(10)}.{rnd.randrange(10)}",
        lambda: " ".join(str(rnd.randrange(100)) for _ in range(rnd.randint(4, 9))),
    )[kind - 4]()


def sample(seed: int, size: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made texts with the entities that were put in."""
    rnd, out = random.Random(seed), []
    make = dict(zip(KINDS, (_email, _ip, _card, _phone)))
    for _ in range(size):
        text, spans = "", []
        for _ in range(rnd.randint(1, 5)):
            text += "".join(_word(rnd) + rnd.choice([" ", " ", " ", " ", ", ", ". ", "\n"]) for _ in range(rnd.randint(0, 5)))
            if rnd.random() < 0.55:
                kind = rnd.choice(KINDS)
                if rnd.random() < 0.35:
                    text += rnd.choice(sorted(CUES[kind])) + rnd.choice([" ", ": ", " "])
                piece = make[kind](rnd)
                spans.append((len(text), len(text) + len(piece), kind))
            else:
                if rnd.random() < 0.35:
                    text += rnd.choice(sorted(CUES["other"])) + rnd.choice([" ", ": ", " "])
                piece = _other(rnd)
            text += piece + rnd.choice([" ", " ", " ", ". ", ", ", "\n", "### ", "; "])
        out.append((text, spans))
    return out


class Objective:
    """Conditional log-likelihood of the made texts' segmentations, less a quarter percent of the squared weights per text."""

    def __init__(self, texts: list[tuple[str, list[tuple[int, int, str]]]]):
        rows, self.lattices, self.gold = [], [], np.zeros(len(FEATURES))
        self.size, self.lost = len(texts), 0
        for text, spans in texts:
            base = base_spans(text)
            for a, b in _stretches(text, base):
                lattice = Lattice(text, a, b, [x for x in base if a <= x[0] and x[1] <= b])
                if not lattice.arcs:
                    continue
                arcs = {(lattice.cuts[i], lattice.cuts[j], KINDS[k]): n for n, (i, j, k) in enumerate(lattice.arcs)}
                mine = [arcs[x] for x in spans if x in arcs]
                self.lost += sum(a <= x[0] < b and x not in arcs for x in spans)
                for f in (f for n in mine for f in lattice.features[n]):
                    self.gold[f] += 1
                for x, y in zip(mine, mine[1:]):
                    if lattice.arcs[x][1] == lattice.arcs[y][0]:
                        self.gold[FEATURES["after:same" if lattice.arcs[x][2] == lattice.arcs[y][2] else "after:other"]] += 1
                self.lattices.append((len(lattice.cuts) - 1, lattice.arcs, len(rows)))
                rows += lattice.features
        self.table = np.zeros((len(rows), len(FEATURES)))
        for i, features in enumerate(rows):
            self.table[i, features] = 1

    def __call__(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The value and its gradient, by sums over all segmentations from both ends."""
        scores = self.table @ weights
        expected, follow, logs = np.zeros(len(scores)), np.zeros(2), 0.0
        raise_by = np.exp(weights[[FEATURES["after:same"], FEATURES["after:other"]]])
        outside, labels = len(KINDS), len(KINDS) + 1
        step = np.full((labels, labels), raise_by[1])  # from label, to label
        step[range(labels), range(labels)] = raise_by[0]
        step[outside, :] = step[:, outside] = 1.0
        for n, arcs, first in self.lattices:
            weight = np.exp(scores[first : first + len(arcs)])
            ahead, behind = np.zeros((n + 1, labels)), np.zeros((n + 1, labels))
            ahead[0, outside] = 1
            at = 0
            for end in range(1, n + 1):
                ahead[end, outside] = ahead[end - 1].sum()
                while at < len(arcs) and arcs[at][1] == end:
                    i, _, k = arcs[at]
                    ahead[end, k] += weight[at] * (ahead[i] @ step[:, k])
                    at += 1
            # behind[i, label]: weight of all that may follow i, after label
            behind[n] = 1
            starts: dict[int, list[int]] = {}
            for x, (i, _, _) in enumerate(arcs):
                starts.setdefault(i, []).append(x)
            for i in range(n - 1, -1, -1):
                behind[i] += behind[i + 1, outside]
                for x in starts.get(i, ()):
                    _, j, k = arcs[x]
                    behind[i] += step[:, k] * (weight[x] * behind[j, k])
            total = ahead[n].sum()
            logs += math.log(total)
            for x, (i, j, k) in enumerate(arcs):
                through = ahead[i] * step[:, k] * (weight[x] * behind[j, k] / total)
                expected[first + x] = through.sum()
                follow[0] += through[k]
                follow[1] += through.sum() - through[k] - through[outside]
        moments = self.table.T @ expected
        moments[FEATURES["after:same"]] += follow[0]
        moments[FEATURES["after:other"]] += follow[1]
        value = self.gold @ weights - logs - 0.0025 * self.size * (weights @ weights)
        return value / self.size, (self.gold - moments) / self.size - 0.005 * weights


TRAINING = (8, 1500)  # seed and number of made texts


def fit(texts, *, steps: int = 250, rate: float = 0.2) -> np.ndarray:
    """Weights by Adam on the objective."""
    objective = Objective(texts)
    weights, mean, square = np.zeros(len(FEATURES)), 0.0, 0.0
    for t in range(1, steps + 1):
        _, grad = objective(weights)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        weights = weights + rate * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return weights


# fit(sample(*TRAINING)), rounded; a test holds them against the objective's gradient.
_FITTED = {
    "email:bias": -0.114,
    "ip:bias": -1.112,
    "card:bias": -2.83,
    "phone:bias": -3.175,
    "email:base": 1.885,
    "ip:base": 1.769,
    "card:base": 2.147,
    "phone:base": 2.169,
    "email:cue": 1.647,
    "ip:cue": 1.295,
    "card:cue": 1.0,
    "phone:cue": 1.713,
    "email:other cue": 0.0,
    "ip:other cue": -3.319,
    "card:other cue": -1.236,
    "phone:other cue": -1.168,
    "email:cut": -2.736,
    "ip:cut": -2.089,
    "card:cut": -0.523,
    "phone:cut": -1.245,
    "email:mark": -0.412,
    "email:spoken": 0.298,
    "email:spaced": -0.927,
    "email:ending": 3.152,
    "ip:range": 1.255,
    "ip:zero": -2.853,
    "card:luhn": 3.433,
    "card:even": 0.98,
    "card:mixed": -0.291,
    "card:length": -0.134,
    "phone:plus": 2.115,
    "phone:paren": 1.532,
    "phone:length": 2.044,
    "phone:short": -0.396,
    "phone:bare": -1.136,
    "phone:one": -1.027,
    "phone:groups": -0.589,
    "phone:date": -0.763,
    "phone:last": 1.351,
    "phone:trunk": 2.406,
    "after:same": 0.0,
    "after:other": 0.0,
}
WEIGHTS = [_FITTED[name] for name in FEATURES]


# --- over a table -----------------------------------------------------------

_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def scan(docs: DataFrame, *, keep: list, text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, with base (matches of the four patterns) and spans (these and what the CRF adds).

    Offsets are code points, ends exclusive; both lists hold kinds in the order
    of ``KINDS``, then go by start. Base matches of one kind never overlap; an
    entity is added only where it overlaps no base match. Null and empty texts
    have neither. Repeated rows stay, an empty table gives none; ``keep`` must
    not hold ``base`` or ``spans``.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for batch in batches:
            base, spans = [], []
            for value in batch.column(batch.num_columns - 1):
                own = value.as_py()
                found = base_spans(own)
                base.append(record(found))
                spans.append(record(all_spans(found, entities(own, found))))
            columns = [*batch.columns[:-1], pa.array(base, _SPAN_TYPE), pa.array(spans, _SPAN_TYPE)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "base", "spans"])

    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])
    return rows.mapInArrow(run, StructType([*kept, StructField("base", ArrayType(span)), StructField("spans", ArrayType(span))]))
