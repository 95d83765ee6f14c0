"""Labels that are drawn as colours behind or under words of an image.

FIXED VALUES: the palette and limits are given."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

PALETTE = {
    "Account Number": "#6d28d9", "Address": "#dc2626", "Business Name": "#14b8a6", "Contact Number": "#f97316", "Credentials": "#fb7185", "Date": "#ec4899",
    "Email Address": "#16a34a", "IP Address": "#22d3ee", "Overscrubbed": "#fecdd3", "Person Name": "#2563eb", "URL/Link": "#f59e0b",
    "Person Username": "#3730a3", "Vehicle Number Plate": "#84cc16",
}


def rgb(colour: str) -> np.ndarray:
    return np.array([int(colour[i : i + 2], 16) for i in (1, 3, 5)], float)


def hexed(colour) -> str:
    return "#" + "".join(f"{int(v + 0.5):02x}" for v in colour)


def distance(a, b) -> float:
    return float(np.sqrt(((np.asarray(a, float) - np.asarray(b, float)) ** 2).mean()))


def pixels(data: bytes, width: int, height: int, bgra: bool = False) -> np.ndarray:
    """(height, width, 3) in the order red, green, blue."""
    x = np.frombuffer(data, np.uint8)[: width * height * 4].reshape(height, width, 4)[:, :, :3]
    return x[:, :, ::-1] if bgra else x


def blank(image: np.ndarray) -> bool:
    """Nearly one colour: the green of every 97th pixel varies by less than eight."""
    g = image.reshape(-1, 3)[::97, 1]
    return not len(g) or int(g.max()) - int(g.min()) < 8


def _upper_median(c: np.ndarray) -> tuple[int, int, int]:
    return tuple(int(v) for v in np.sort(c, axis=0)[len(c) >> 1])


def tint_behind(image: np.ndarray, box) -> tuple[int, int, int] | None:
    """The light colour of at least 22 % of sampled pixels."""
    x, y, w, h = (int(np.floor(v + 0.5)) for v in box)
    step = max(1, min(w, h) // 10)
    part = image[max(0, y) : max(0, y + h) : step, max(0, x) : max(0, x + w) : step].reshape(-1, 3)
    most = part.max(1)
    tinted = part[(most >= 150) & (most - part.min(1) >= 12)] if len(part) else part
    return _upper_median(tinted) if len(part) and len(tinted) / len(part) >= 0.22 else None


def underline_below(image: np.ndarray, box) -> tuple[int, int, int] | None:
    """The colour of the first line of pixels below a word that is coloured over 70 % of its width."""
    x, y, w, h = (int(np.floor(v + 0.5)) for v in box)
    rows = slice(max(0, y + h - 2), max(0, min(image.shape[0] - 1, y + h + max(6, int(h * 0.4 + 0.5))) + 1))
    part = image[rows, max(0, x + 2) : max(0, min(image.shape[1], x + w - 2)) : max(1, w // 16)]
    if part.shape[1] < 4:
        return None
    coloured = np.ptp(part, 2) >= 18
    lines = coloured.sum(1) / part.shape[1] >= 0.7
    return _upper_median(part[k := int(lines.argmax())][coloured[k]]) if lines.any() else None


def over_white(tint, colour) -> tuple[float, float]:
    """How far a tint is from the colour laid over white, and the share of the colour that fits best."""
    lack, t = 255 - np.asarray(colour, float), 255 - np.asarray(tint, float)
    alpha = float(min(1.0, max(0.04, (t @ lack) / (lack @ lack)))) if lack.any() else 0.0
    return distance(255 - alpha * lack, tint), alpha


def label_of_tint(tint, taught: dict[str, str] | None = None, palette: dict[str, str] = PALETTE) -> str | None:
    """Taught colours (of less than 12 off) come first, then palette colours over white (of less than 11 off)."""
    near = [(d, k, label) for k, (h, label) in enumerate((taught or {}).items()) if (d := distance(rgb(h), tint)) < 12]
    near = near or [(d, k, label) for k, (label, h) in enumerate(palette.items()) if (d := over_white(tint, rgb(h))[0]) < 11]
    return min(near)[2] if near else None


def label_of_line(colour, taught: dict[str, str] | None = None, palette: dict[str, str] = PALETTE) -> str | None:
    """The nearest colour within 45, unless another label's is nearly as near."""
    every = [(label, h) for h, label in (taught or {}).items()] + list(palette.items())
    near = sorted(((distance(rgb(h), colour), k, label) for k, (label, h) in enumerate(every)))
    if not near or near[0][0] > 45 or len(near) > 1 and near[1][2] != near[0][2] and near[1][0] - near[0][0] < 8:
        return None
    return near[0][2]


@lru_cache(maxsize=1 << 14)
def _told(of: Callable, colour: tuple[int, int, int], taught: tuple[tuple[str, str], ...]) -> str | None:
    """The label of a colour; images have few colours, which are told once."""
    return of(colour, dict(taught))


def labels_in(text: str, words: list[dict], image: np.ndarray, taught: dict[str, str] | None = None) -> tuple[list[dict], list[dict]]:
    """Spans of labelled words, and the colours that are no label's."""
    spans: list[dict] = []
    unknown: dict[str, dict] = {}
    open_ = False
    known = tuple((taught or {}).items())
    for w in words:
        tint = tint_behind(image, w["box"])
        label = _told(label_of_tint, tint, known) if tint else None
        if label is None and (line := underline_below(image, w["box"])):
            label = _told(label_of_line, line, known)
        if tint and label is None:
            steps = [min(255, int(v / 6 + 0.5) * 6) for v in tint]
            u = unknown.setdefault(hexed(steps), {"hex": hexed(tint), "count": 0, "example": ""})
            u["count"] += 1
            if len(u["example"]) < 40:
                u["example"] = (u["example"] + " " + text[w["start"] : w["end"]]).strip()
        if label and open_ and spans[-1]["site_label"] == label and not text[spans[-1]["end"] : w["start"]].strip():
            spans[-1]["end"] = w["end"]
        elif label:
            spans.append({"site_label": label, "start": w["start"], "end": w["end"]})
        open_ = label is not None
    for s in spans:
        said = text[s["start"] : s["end"]]
        s["end"] -= len(said) - len(said.rstrip(",.;:)]"))
        said = text[s["start"] : s["end"]]
        s["start"] += len(said) - len(said.lstrip("(["))
        s["text"] = text[s["start"] : s["end"]]
    return [s for s in spans if s["text"].strip()], sorted(unknown.values(), key=lambda u: -u["count"])


def spans_of_rows(rows: list[dict], joined: dict) -> list[dict]:
    """Labels of rows as spans of the joined text; one that goes on at the beginning of the next row stays one."""
    spans: list[dict] = []
    for k, (row, at) in enumerate(zip(rows, joined["row_starts"])):
        for x in row.get("labels") or []:
            before = joined["row_starts"][k - 1] + len(rows[k - 1]["text"]) if k else None
            if spans and spans[-1]["site_label"] == x["site_label"] and x["start"] == 0 and spans[-1]["end"] == before:
                spans[-1]["end"] = at + x["end"]
            else:
                spans.append({"site_label": x["site_label"], "start": at + x["start"], "end": at + x["end"]})
    return [{**s, "text": joined["text"][s["start"] : s["end"]]} for s in spans]


def fingerprint(*images: np.ndarray) -> str:
    """Of sampled pixels of both sides, to see whether a read changed."""
    import hashlib

    h = hashlib.sha1()
    for x in images:
        h.update(str(x.shape).encode() + np.ascontiguousarray(x.reshape(-1, x.shape[-1])[::53]).tobytes())
    return h.hexdigest()
