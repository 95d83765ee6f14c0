"""Spans of a text and what is done with a list of them: trimming, de-duplication, choice among overlapping ones."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from typing import NamedTuple

from veilspark.functions.patterns import REVIEW_THRESHOLD, SPECIFICITY, TRAILING

_RANK = {label: k for k, label in enumerate(SPECIFICITY)}


class Span(NamedTuple):
    """A detection; offsets count code points, the end is exclusive."""

    start: int
    end: int
    label: str
    confidence: float
    source: str
    rule: str
    text: str


def confidence(x: float) -> float:
    """Between 0.01 and 0.99, half up to two places."""
    return math.floor(min(0.99, max(0.01, x)) * 100 + 0.5) / 100


def rank(label: str) -> int:
    return _RANK.get(label, len(SPECIFICITY))


def trimmed_end(text: str, start: int, end: int) -> int:
    """Before trailing punctuation and closing brackets that nothing opened."""
    while end > start and (text[end - 1] in TRAILING or text[end - 1] == ")" and text.count("(", start, end) < text.count(")", start, end)):
        end -= 1
    return end


def once(spans: list[Span]) -> list[Span]:
    """For each place and label the surest, the first of equals; in order of first appearance."""
    best: dict[tuple, Span] = {}
    for s in spans:
        key = (s.start, s.end, s.label)
        if key not in best or s.confidence > best[key].confidence:
            best[key] = s
    return list(best.values())


_EDGE = " \t\n\r\v\f ﻿  ,;:-–"


def without_edges(spans: list[Span], text: str) -> list[Span]:
    """Addresses lose what sure detections of another kind hold of their edges; under four characters they go."""
    postal = ("Person Address", "Business Address")
    others = sorted((s for s in spans if s.label not in postal and s.confidence >= REVIEW_THRESHOLD), key=lambda s: s.start)
    out = []
    for s in spans:
        if s.label not in postal:
            out.append(s)
            continue
        a, z = s.start, s.end
        touching = [o for o in others if o.start < s.end and o.end > s.start]
        for _ in range(4):
            before = (a, z)
            for o in touching:
                if o.end <= a or o.start >= z:
                    continue
                if o.start <= a and o.end < z:
                    a = o.end
                elif o.end >= z and o.start > a:
                    z = o.start
            cut = (a, z) != before
            while a < z and text[a] in _EDGE:
                a += 1
            while z > a and text[z - 1] in _EDGE:
                z -= 1
            if not cut:
                break
        if z - a >= 4:
            out.append(s if (a, z) == (s.start, s.end) else s._replace(start=a, end=z, text=text[a:z]))
    return out


def disjoint(spans: list[Span]) -> list[Span]:
    """Longest first, then the more specific label, the surer, the earlier; each that overlaps none taken so far."""
    taken: list[tuple[int, int, Span]] = []
    for s in sorted(spans, key=lambda s: (s.start - s.end, rank(s.label), -s.confidence, s.start)):
        i = bisect_left(taken, s.start, key=lambda t: t[0])
        if (i < len(taken) and taken[i][0] < s.end) or (i and taken[i - 1][1] > s.start):
            continue
        insort(taken, (s.start, s.end, s), key=lambda t: t[0])
    return [t[2] for t in taken]


def resolved(spans: list[Span], text: str) -> list[Span]:
    return disjoint(without_edges(once(spans), text))
