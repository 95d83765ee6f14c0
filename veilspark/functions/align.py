"""Word alignment of two texts: common ends, then a shortest edit script within a budget, then unique words in common order."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from typing import NamedTuple

#: Edit operations that a script may have, halvings after that, and words that a placeholder may stand for.
MOST_EDITS, MOST_DEPTH, MOST_GAP = 1500, 4, 60


class Token(NamedTuple):
    low: str
    start: int
    end: int


def _wordish(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMN"


_ASCII_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


class _Kinds(dict):
    """By code point an ASCII character of its kind: itself, a letter, a blank or a sign."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = c if code < 128 else "a" if _wordish(c) else " " if c.isspace() or code == 0xFEFF else "!"
        self[code] = kind
        return kind


_KINDS = _Kinds()


def tokens(text: str) -> list[Token]:
    """Runs of letters, marks and digits, and every other sign that is not white space."""
    shape = text if text.isascii() else text.translate(_KINDS)
    spans = [m.span() for m in _ASCII_TOKEN.finditer(shape)]
    return [Token(text[i:j].lower(), i, j) for i, j in spans]


def wordy(t: str) -> bool:
    return any(unicodedata.category(c)[0] in "LN" for c in t)


def _common(a: list[str], b: list[str], most: int) -> int:
    """How many of the first words are the same on both sides: whole stretches are compared, and halved where they differ."""
    low, step = 0, most
    while step:
        step = min(step, most - low)
        if a[low : low + step] == b[low : low + step]:
            low += step
            if low == most:
                break
        else:
            step //= 2
    return low


class Alignment:
    """left[i] is the right place of left token i, right[j] the left place of right token j; -1 for none."""

    def __init__(self, a: list[str], b: list[str]):
        self.left, self.right = [-1] * len(a), [-1] * len(b)
        self._a, self._b = a, b
        both = min(len(a), len(b))
        low = _common(a, b, both)
        ends = _common(a[::-1], b[::-1], both - low)
        i, j = len(a) - ends, len(b) - ends
        self.left[:low] = self.right[:low] = range(low)
        self.left[i:], self.right[j:] = range(j, len(b)), range(i, len(a))
        self._solve(low, i, low, j, 0)

    def _pair(self, i: int, j: int) -> None:
        self.left[i], self.right[j] = j, i

    def _solve(self, a0: int, a1: int, b0: int, b1: int, depth: int) -> None:
        if a0 >= a1 or b0 >= b1 or self._script(a0, a1, b0, b1) or depth > MOST_DEPTH:
            return
        anchors = self._anchors(a0, a1, b0, b1)
        for i, j in anchors:
            self._solve(a0, i, b0, j, depth + 1)
            self._pair(i, j)
            a0, b0 = i + 1, j + 1
        if anchors:
            self._solve(a0, a1, b0, b1, depth + 1)

    def _script(self, a0: int, a1: int, b0: int, b1: int) -> bool:
        """Greedy furthest-reaching paths. Each step keeps its frontier as a dictionary from diagonal to row, which is
        enough to walk back; steps are bounded by MOST_EDITS, so memory is by its square."""
        a, b = self._a[a0:a1], self._b[b0:b1]
        n, m = len(a), len(b)
        far: dict[int, int] = {1: 0}
        steps: list[dict[int, int]] = []
        for d in range(min(n + m, MOST_EDITS) + 1):
            now: dict[int, int] = {}
            for k in range(-d, d + 1, 2):
                x = far.get(k + 1, 0) if k == -d or (k != d and far.get(k - 1, 0) < far.get(k + 1, 0)) else far.get(k - 1, 0) + 1
                y = x - k
                while x < n and y < m and a[x] == b[y]:
                    x, y = x + 1, y + 1
                now[k] = far[k] = x
                if x >= n and y >= m:
                    self._back(steps, n, m, a0, b0)
                    return True
            steps.append(now)
        return False

    def _back(self, steps: list[dict[int, int]], x: int, y: int, a0: int, b0: int) -> None:
        for d in range(len(steps), 0, -1):
            before, k = steps[d - 1], x - y
            down = k == -d or (k != d and before[k - 1] < before[k + 1])
            px = before[k + 1 if down else k - 1]
            py = px - (k + 1 if down else k - 1)
            while x > px and y > py:
                x, y = x - 1, y - 1
                self._pair(a0 + x, b0 + y)
            x, y = px, py
        while x > 0 and y > 0:
            x, y = x - 1, y - 1
            self._pair(a0 + x, b0 + y)

    def _anchors(self, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
        """Words that each side has once, in the longest order common to both."""
        once: list[dict[str, int]] = []
        for words, low, high in ((self._a, a0, a1), (self._b, b0, b1)):
            place: dict[str, int] = {}
            for i in range(low, high):
                place[words[i]] = -1 if words[i] in place else i
            once.append({w: i for w, i in place.items() if i >= 0})
        both = sorted((i, once[1][w]) for w, i in once[0].items() if w in once[1])
        ends: list[int] = []
        last: list[int] = []
        back = [-1] * len(both)
        for k, (_, j) in enumerate(both):
            at = bisect_left(ends, j)
            ends[at : at + 1], last[at : at + 1] = [j], [k]
            back[k] = last[at - 1] if at else -1
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        return chain[::-1]


def touched(ts: list[Token], start: int, end: int) -> tuple[int, int] | None:
    """First and last token that overlap a range."""
    first = bisect_right(ts, start, key=lambda t: t.end)
    last = bisect_left(ts, end, key=lambda t: t.start) - 1
    return (first, last) if first < len(ts) and ts[first].start < end and last >= first else None


def neighbours(to: list[int], first: int, last: int, n: int) -> tuple[int, int]:
    """Matched places just before and after a range of tokens; -1 and n at the ends."""
    before = next((to[i] for i in range(first - 1, -1, -1) if to[i] >= 0), -1)
    after = next((to[i] for i in range(last + 1, len(to)) if to[i] >= 0), n)
    return before, after


def mapped(first: int, last: int, to: list[int], other: list[Token]) -> tuple[int, int, bool] | None:
    """Where a range of tokens is on the other side: around its matches, else (False) the gap between its neighbours."""
    places = [to[i] for i in range(first, last + 1) if to[i] >= 0]
    if places:
        return other[min(places)].start, other[max(places)].end, True
    low, high = neighbours(to, first, last, len(other))
    low, high = low + 1, high - 1
    while low <= high and not wordy(other[low].low):
        low += 1
    while high >= low and not wordy(other[high].low):
        high -= 1
    return None if low > high or high - low + 1 > MOST_GAP else (other[low].start, other[high].end, False)


def hunks(a: Alignment) -> list[tuple[int, int, int, int]]:
    """Maximal runs (i0, i1, j0, j1) of unmatched tokens between matches."""
    out, i, j = [], 0, 0
    n, m = len(a.left), len(a.right)
    while i < n or j < m:
        if i < n and j < m and a.left[i] == j:
            i, j = i + 1, j + 1
            continue
        i0, j0 = i, j
        while i < n and a.left[i] < 0:
            i += 1
        while j < m and a.right[j] < 0:
            j += 1
        if (i, j) == (i0, j0):
            i, j = min(i + 1, n), min(j + 1, m)
        out.append((i0, i, j0, j))
    return out
