"""Reads of a screen (lines and words with boxes) as rows of text, and rows as one text.

A row is a dict: text, words [{start, end, box}], para (a paragraph begins), top, bottom, clipped (cut by the edge)."""

from __future__ import annotations

import re

_LONG = re.compile(r"[^\W\d_]{5,}")


def garbled(text: str) -> bool:
    """Half of the long words or more can't be words: no vowel, flipping case, or capital i next to small L."""
    long = [re.sub(r"[\W\d_]", "", w) for w in text.split() if _LONG.search(w)]
    odd = [w for w in long if not re.search("[aeiouy]", w, re.I) or sum(a.islower() and b.isupper() for a, b in zip(w, w[1:])) >= 2 or "lI" in w or "Il" in w]
    return len(long) >= 2 and 2 * len(odd) >= len(long)


def middle(box: list[float]) -> float:
    return box[1] + box[3] / 2


def line_groups(lines: list[dict]) -> list[dict]:
    """Lines of one height, top to bottom; in a group from left to right."""
    groups: list[dict] = []
    for line in sorted((x for x in lines if x["text"].strip()), key=lambda x: middle(x["box"])):
        y, h = line["box"][1], line["box"][3]
        g = groups[-1] if groups else None
        if g and abs(middle(line["box"]) - g["mid"]) < min(h, g["height"]) / 2:
            g["lines"].append(line)
            g["top"], g["bottom"] = min(g["top"], y), max(g["bottom"], y + h)
        else:
            groups.append({"lines": [line], "mid": middle(line["box"]), "height": h, "top": y, "bottom": y + h})
    for g in groups:
        g["lines"].sort(key=lambda x: x["box"][0])
    return groups


def rows_of_read(read: dict) -> list[dict]:
    groups = line_groups([x for x in read.get("lines") or [] if not garbled(x["text"])])
    out: list[dict] = []
    for k, g in enumerate(groups):
        words, at = [], 0
        for line in g["lines"]:
            cursor = 0
            for w in line.get("words") or []:
                i = line["text"].find(w["text"], cursor)
                if i >= 0:
                    cursor = i + len(w["text"])
                    words.append({"start": at + i, "end": at + cursor, "box": list(w["box"])})
            at += len(line["text"]) + 1
        before = groups[k - 1] if k else None
        para = before is not None and g["top"] - before["bottom"] > 0.9 * min(g["height"], before["height"])
        edge, height = max(3, 0.6 * g["height"]), read.get("height")
        out.append({"text": " ".join(x["text"] for x in g["lines"]), "words": words, "para": para, "top": g["top"], "bottom": g["bottom"], "clipped": bool(height) and (g["top"] <= edge or g["bottom"] >= height - edge)})
    return out


def joined(rows: list[dict]) -> dict:
    """{text, words with boxes and rows, row_starts}; a blank line before a paragraph."""
    text, words, starts = "", [], []
    for k, r in enumerate(rows):
        text += ("\n\n" if r.get("para") else "\n") if k else ""
        starts.append(len(text))
        words += [{"start": len(text) + w["start"], "end": len(text) + w["end"], "box": w["box"], "row": k} for w in r["words"] if w.get("box")]
        text += r["text"]
    return {"text": text, "words": words, "row_starts": starts}


def boxes_for(words: list[dict], start: int, end: int) -> list[list[float]]:
    """The hull of the words of text[start:end] in each row."""
    hulls: dict[int, list[float]] = {}
    for w in words:
        if w.get("box") and w["start"] < end and w["end"] > start:
            x, y, wide, high = w["box"]
            a = hulls.setdefault(w["row"], [x, y, x + wide, y + high])
            hulls[w["row"]] = [min(a[0], x), min(a[1], y), max(a[2], x + wide), max(a[3], y + high)]
    return [[a, b, c - a, d - b] for a, b, c, d in hulls.values()]


def on_screen(box: list[float], scale: float, x: float = 0, y: float = 0) -> dict:
    """A box of pixels as points of the screen."""
    return {"x": x + box[0] / scale, "y": y + box[1] / scale, "width": box[2] / scale, "height": box[3] / scale}
