"""What a value costs to guess: the cheapest way to put it together from parts.

Dynamic programming over the positions of a value. A part is a word of a ranked list, a date, a
repeated unit, a walk on the keyboard, or a span to be tried character by character; its cost is
the decimal logarithm of the guesses it takes, and costs of parts add up.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

#: Rows of the usual keyboard, plain and with shift.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED_ROWS = ("!@#$%^&*()_+", "QWERTYUIOP{}", "ASDFGHJKL:\"", "ZXCVBNM<>?")
#: Signs written in place of letters.
SIGNS = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
#: Often used passwords, most frequent first; they rank before the words of a corpus.
COMMON = (
    "password", "admin", "letmein", "welcome", "secret", "changeme", "default", "master", "login", "root",
    "test", "guest", "monkey", "dragon", "football", "iloveyou", "sunshine", "princess", "example", "user",
)
DATES = re.compile(
    r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])))"
    r"|(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\4(?:19|20)\d\d))")
YEARS = re.compile(r"(?=((?:19|20)\d\d))")

DIGIT = 1.0
LONGEST_WORD, LONGEST_UNIT = 24, 8


class Part(NamedTuple):
    begin: int
    end: int
    kind: str
    cost: float


def _neighbours() -> dict[str, frozenset[str]]:
    """Keys beside a key, by the half-key offset of the rows."""
    at = {}
    for plain, shifted in zip(KEY_ROWS, SHIFTED_ROWS):
        y = KEY_ROWS.index(plain)
        for x, pair in enumerate(zip(plain, shifted)):
            at |= {c: (y, x + y / 2) for c in pair}
    return {a: frozenset(b for b, (v, u) in at.items() if (v, u) != (y, x) and abs(v - y) <= 1 and abs(u - x) <= 1)
            for a, (y, x) in at.items()}


NEAR = _neighbours()
WALK_START, WALK_STEP = math.log10(len(NEAR)), math.log10(2)


class GuessCost:
    """Costs under a list of words, most frequent first. ``segments`` returns the cheapest parts
    (ties: the part that begins first, then the order word, date, repeat, walk, brute), ``cost`` their sum."""

    def __init__(self, words: list[str]):
        ranked = dict.fromkeys((*COMMON, *words))
        self.rank = {w: math.log10(i + 1) for i, w in enumerate(ranked)}

    def segments(self, value: str) -> list[Part]:
        n = len(value)
        ending: list[list[Part]] = [[] for _ in range(n + 1)]
        for part in self._parts(value):
            ending[part.end].append(part)
        best, came = [0.0] * (n + 1), [Part(0, 0, "", 0.0)] * (n + 1)
        repeats = _Repeats(value)
        for j in range(1, n + 1):
            # A brute-force span may have any length: its last character costs what each does.
            best[j], came[j] = best[j - 1] + DIGIT, Part(j - 1, j, "brute", DIGIT)
            for part in ending[j]:
                if best[part.begin] + part.cost < best[j]:
                    best[j], came[j] = best[part.begin] + part.cost, part
            for begin, unit, times in repeats.ending(j):
                cost = self._unit(value[begin:begin + unit]) + math.log10(times)
                if best[begin] + cost < best[j]:
                    best[j], came[j] = best[begin] + cost, Part(begin, j, "repeat", cost)
        parts: list[Part] = []
        while n:
            part = came[n]
            if part.kind == "brute" and parts and parts[-1].kind == "brute":
                last = parts.pop()
                part = Part(part.begin, last.end, "brute", part.cost + last.cost)
            parts.append(part)
            n = part.begin
        return parts[::-1]

    def cost(self, value: str) -> float:
        return sum(p.cost for p in self.segments(value))

    def _unit(self, unit: str) -> float:
        """A repeated unit is a word, a walk or brute force."""
        near = len(unit) > 2 and all(b in NEAR.get(a, ()) for a, b in zip(unit, unit[1:]))
        return min(self._word(unit), DIGIT * len(unit), _walk(unit, 0, len(unit)).cost if near else math.inf)

    def _word(self, text: str) -> float:
        low = text.lower()
        plain = low.translate(SIGNS)
        cost = min(self.rank.get(low, math.inf), self.rank.get(plain, math.inf) + math.log10(2) * sum(a != b for a, b in zip(low, plain)))
        capitals = sum(c.isupper() for c in text)
        if capitals == 0:
            return cost
        usual = capitals == len(text) or (capitals == 1 and text[0].isupper())
        return cost + math.log10(2) * (1 if usual else capitals + 1)

    def _parts(self, value: str) -> Iterator[Part]:
        for i in range(len(value)):
            for j in range(i + 3, min(i + LONGEST_WORD, len(value)) + 1):
                cost = self._word(value[i:j])
                if cost < math.inf:
                    yield Part(i, j, "word", cost)
        for m in DATES.finditer(value):
            found = m.group(1) or m.group(3)
            # Two hundred years, 372 days, and a sign between them.
            yield Part(m.start(), m.start() + len(found), "date", math.log10(200 * 372) + (math.log10(4) if m.group(2) or m.group(4) else 0))
        for m in YEARS.finditer(value):
            yield Part(m.start(), m.start() + 4, "date", math.log10(200))
        yield from _walks(value)


class _Repeats:
    """Longest repeats of units of at most ``LONGEST_UNIT`` characters that end at a position."""

    def __init__(self, value: str):
        self.value = value
        self.run = [0] * (LONGEST_UNIT + 1)

    def ending(self, j: int) -> Iterator[tuple[int, int, int]]:
        """(begin, unit, times) of repeats that end before ``j``; called for j = 1, 2, ..."""
        v, run = self.value, self.run
        for unit in range(1, LONGEST_UNIT + 1):
            run[unit] = run[unit] + 1 if j > unit and v[j - 1] == v[j - 1 - unit] else 0
            times = run[unit] // unit + 1
            if times > 1 and times * unit >= 3:
                yield j - times * unit, unit, times


def _walks(value: str) -> Iterator[Part]:
    """Parts of three to ``LONGEST_WORD`` keys that lie side by side, and whole longer walks."""
    begin = 0
    for end in range(1, len(value) + 1):
        if end < len(value) and value[end] in NEAR.get(value[end - 1], ()):
            continue
        for i in range(begin, end - 2):
            for j in range(i + 3, min(i + LONGEST_WORD, end) + 1):
                yield _walk(value, i, j)
        if end - begin > LONGEST_WORD:
            yield _walk(value, begin, end)
        begin = end


def _walk(value: str, i: int, j: int) -> Part:
    """Every turn doubles the guesses eightfold; a straight walk costs its start and length."""
    turns, step = 0, None
    for a, b in zip(value[i:j], value[i + 1:j]):
        now = (a in KEY_AT and b in KEY_AT) and (KEY_AT[b][0] - KEY_AT[a][0], KEY_AT[b][1] - KEY_AT[a][1])
        turns += now != step
        step = now
    return Part(i, j, "walk", WALK_START + 3 * WALK_STEP * turns + math.log10(j - i))


KEY_AT = {c: (y, x + y / 2) for y, rows in enumerate(zip(KEY_ROWS, SHIFTED_ROWS)) for x, pair in enumerate(zip(*rows)) for c in pair}
