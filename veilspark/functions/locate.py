"""Where two documents stand side by side on a screen: the edge between them, their lines, and their panes.

FIXED VALUES: the patterns of page text, headers and footers are given."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

CHROME = re.compile(r"\.(pdf|docx?|txt|png|jpe?g|csv|json|xlsx?)\b|read-only|annotate here|reference|^labels?\b|\bannotations?$|^(close|submit|save|cancel|approve|reject)\b", re.I)
HEADER = re.compile(r"\.(pdf|docx?|txt|png|jpe?g)\b|read-only|annotate here|reference", re.I)
FOOTER = re.compile(r"\bannotations?$|^(close|submit|save|cancel)\b", re.I)
#: Points around a block of text.
PAD = 12


@dataclass
class Line:
    text: str
    x1: float
    x2: float
    y1: float
    y2: float
    words: frozenset[str]

    @property
    def chrome(self) -> bool:
        return CHROME.search(self.text.strip()) is not None

    @property
    def mid(self) -> float:
        return (self.y1 + self.y2) / 2

    def alike(self, other: Line) -> bool:
        a, b = self.words, other.words
        return min(len(a), len(b)) >= 2 and len(a & b) >= 0.6 * max(len(a), len(b))


@dataclass
class Block:
    lines: list[Line]
    top: float = field(init=False)
    bottom: float = field(init=False)

    def __post_init__(self):
        self.top, self.bottom = self.lines[0].y1, self.lines[-1].y2
        self.left, self.right = min(x.x1 for x in self.lines), max(x.x2 for x in self.lines)

    def pitch(self, scale: float) -> float:
        steps = sorted(b.y1 - a.y1 for a, b in zip(self.lines, self.lines[1:]))
        return (steps[len(steps) >> 1] if steps else 0) or 40 * scale

    def column(self, lines: list[Line], scale: float) -> list[Line]:
        return sorted((x for x in lines if self.left - 40 * scale <= x.x1 <= self.right), key=lambda x: x.y1)


def lines_of(read: dict) -> list[Line]:
    words = lambda t: frozenset(w for w in re.split(r"(?:[^\w@.]|_)+", t.lower()) if len(w) > 1)
    return [Line(x["text"], x["box"][0], x["box"][0] + x["box"][2], x["box"][1], x["box"][1] + x["box"][3], words(x["text"])) for x in read.get("lines") or [] if len(x["text"].strip()) > 1]


def _split(lines: list[Line], width: float, scale: float):
    """The edge at which most lines have their like on the other side; of equals the one that cuts fewer sentences."""
    tol, best = 4 * scale, None
    for edge in sorted({int(x.x1 / (10 * scale) + 0.5) * 10 * scale for x in lines})[1:]:
        a, b = [x for x in lines if x.x2 <= edge + tol], [x for x in lines if x.x1 >= edge - tol]
        if len(a) < 3 or len(b) < 3:
            continue
        pairs = sum(any(x.alike(y) for y in b) for x in a)
        cut = sum(x.x1 < edge - tol and x.x2 > edge + tol and x.x2 - x.x1 <= 0.6 * width and len(x.words) >= 4 for x in lines)
        if best is None or (pairs, -cut) > (best[1], -best[2]):
            best = (edge, pairs, cut, a, b)
    return best if best and best[1] >= 3 else None


def _block(own: list[Line], other: list[Line]) -> Block | None:
    words = frozenset().union(*(x.words for x in other))
    texts = {x.text.strip().lower() for x in other}
    shared = [x for x in own if not x.chrome and (2 * len(x.words & words) >= len(x.words) if len(x.words) >= 3 else x.text.strip().lower() in texts)]
    return Block(sorted(shared, key=lambda x: x.y1)) if len(shared) >= 2 else None


def _extend(a: Block, b: Block, own: list[Line], other: list[Line], scale: float) -> None:
    """Pairs of changed lines just above and below belong to both, up to four on each side."""
    ca, cb, pa, pb = a.column(own, scale), b.column(other, scale), a.pitch(scale), b.pitch(scale)

    def pair(x: Line | None, y: Line | None, gap) -> bool:
        if x is None or y is None or x.chrome or y.chrome:
            return False
        ga, gb = gap(x, a), gap(y, b)
        return ga <= 2.2 * pa and gb <= 2.2 * pb and (bool(x.words & y.words) or abs(ga / pa - gb / pb) <= 0.6)

    for _ in range(4):
        x, y = ([z for z in c if z.y2 <= k.top + 2][-1:] for c, k in ((ca, a), (cb, b)))
        if not (x and y and pair(x[0], y[0], lambda z, k: k.top - z.y2)):
            break
        a.top, b.top = x[0].y1, y[0].y1
    for _ in range(4):
        x, y = ([z for z in c if z.y1 >= k.bottom - 2][:1] for c, k in ((ca, a), (cb, b)))
        if not (x and y and pair(x[0], y[0], lambda z, k: z.y1 - k.bottom)):
            break
        a.bottom, b.bottom = x[0].y2, y[0].y2


def documents(read: dict, scale: float = 1, x0: float = 0, y0: float = 0) -> dict | None:
    """{left, right, score, panes[, header]} in points of the screen; None without a pair."""
    lines = lines_of(read)
    found = _split(lines, read.get("width") or 1e9, scale) if len(lines) >= 6 else None
    if not found:
        return None
    edge, pairs, _, la, lb = found
    a, b = _block(la, lb), _block(lb, la)
    if not a or not b:
        return None
    _extend(a, b, la, lb, scale)
    score = int(pairs / min(len(la), len(lb)) * 100 + 0.5) / 100
    rect = lambda p, q, r, s: {"x": x0 + p / scale, "y": y0 + q / scale, "width": (r - p) / scale, "height": (s - q) / scale}

    def pane(k: Block, own: list[Line], until: float | None) -> tuple[dict, dict, float] | None:
        heads = [x for x in own if x.y2 <= k.top + 2 and k.top - x.y2 < 6 * k.pitch(scale) and HEADER.search(x.text)]
        if not heads:
            return None
        head = max(heads, key=lambda x: x.y2)
        row = [x for x in own if abs(x.mid - head.mid) < head.y2 - head.y1]
        feet = [x for x in lines if x.y1 >= k.bottom - 2 and FOOTER.search(x.text.strip())]
        bottom = (min(x.y1 for x in feet) if feet else read.get("height") or k.bottom + 40 * scale) - 8 * scale
        top, left = head.y2 + 8 * scale, max(0, min(k.left, *(x.x1 for x in row)) - 14 * scale)
        right = max(k.right + 14 * scale, *(x.x2 for x in row)) if until is None else until
        header = rect(head.x1 - 6 * scale, head.y1 - 4 * scale, head.x2 + 6 * scale, head.y2 + 4 * scale)
        return rect(left, top, right, top + max(bottom - top, 40 * scale)), header, left

    pb = pane(b, lb, None)
    pa = pane(a, la, pb[2]) if pb else None
    if pa and pb:
        return {"left": pa[0], "right": pb[0], "header": pa[1], "score": score, "panes": True}

    def box(k: Block, own: list[Line]) -> dict:
        inside = [x for x in k.column(own, scale) if x.y1 >= k.top - 2 and x.y2 <= k.bottom + 2]
        r = rect(min(x.x1 for x in inside), k.top, max(x.x2 for x in inside), k.bottom)
        return {"x": r["x"] - PAD, "y": r["y"] - PAD, "width": r["width"] + 2 * PAD, "height": r["height"] + 2 * PAD}

    left, right = box(a, la), box(b, lb)
    width = max(left["width"], right["width"])
    left["width"], right["width"] = min(width, edge / scale + x0 - left["x"]), width
    return {"left": left, "right": right, "score": score, "panes": False}
