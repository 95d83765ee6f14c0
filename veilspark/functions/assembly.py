"""A document put together from reads of parts of it.

State is a list of rows in pieces that are known to be in order. A read is laid over the rows by a vote of its lines for
an offset; rows on it are refreshed, rows beyond it extend its piece, and a piece that it runs into is joined to it.
The state is plain data, so that batch code and a stream's state can hold it alike."""

from __future__ import annotations

from collections import Counter
from dataclasses import asdict, dataclass, field, replace
from itertools import takewhile

from veilspark.functions.rowmatch import digits, key, same_line

#: Misses after which a document starts over, if it may; characters that a read has at least.
MOST_MISSES, LEAST_CHARS = 3, 20


@dataclass
class Row:
    text: str
    key: str
    words: list[dict]
    para: bool
    labels: list[dict]
    shown: bool
    piece: int

    def like(self, k: str) -> bool:
        return same_line(self.key, k)


@dataclass
class Assembly:
    rows: list[Row] = field(default_factory=list)
    misses: int = 0
    reads: int = 0
    pieces: int = 1

    def dump(self) -> dict:
        return asdict(self)

    @classmethod
    def load(cls, d: dict) -> Assembly:
        return cls([Row(**r) for r in d["rows"]], d["misses"], d["reads"], d["pieces"])

    def _row(self, r: dict, piece: int, k: str | None = None) -> Row:
        """k: the key of the row's text, where it is known."""
        return Row(r["text"], key(r["text"]) if k is None else k, r.get("words") or [], bool(r.get("para")), r.get("labels") or [], True, piece)

    def _start(self, read: list[dict], keys: list[str]) -> str:
        self.rows, self.misses, self.reads, self.pieces = [self._row(r, 1, k) for r, k in zip(read, keys)], 0, 1, 1
        return "new"

    def _meetings(self, keys: list[str]) -> list[tuple[int, int]]:
        """(i, j): row i of a read may be row j of the document: all of the same key, or else the one that is near."""
        places: dict[str, list[int]] = {}
        for j, row in enumerate(self.rows):
            if len(row.key) >= 4:
                places.setdefault(row.key, []).append(j)
        met: list[tuple[int, int]] = []
        by_digits: dict[str, list[int]] | None = None
        for i, k in enumerate(keys):
            if k in places:
                met += [(i, j) for j in places[k]]
                continue
            if len(k) >= 4:  # no row is equal, and only rows of equal digits can be near
                if by_digits is None:
                    by_digits = {}
                    for j, row in enumerate(self.rows):
                        by_digits.setdefault(digits(row.key), []).append(j)
                could = [j for j in by_digits.get(digits(k), ()) if self.rows[j].like(k)]
            else:
                could = [j for j, row in enumerate(self.rows) if row.key == k]
            met += [(i, j) for j in could] if len(could) == 1 else []
        return met

    def _offset(self, keys: list[str]) -> int | None:
        """How far a read's rows lie behind the document's: what most of its text says, if that is two rows or a long one."""
        said: Counter[int] = Counter()
        by: dict[int, list[int]] = {}
        for i, j in self._meetings(keys):
            said[j - i] += 1 + len(keys[i]) / 40
            by.setdefault(j - i, []).append(len(keys[i]))
        best = said.most_common(1)
        return best[0][0] if best and (len(by[best[0][0]]) >= 2 or by[best[0][0]][0] >= 25) else None

    def add(self, read: list[dict], start_over: bool = False, keep_unmatched: bool = True) -> str:
        """new, merged or ignored. An unmatched read is kept as a piece of its own; with start_over it counts as a
        miss, and after MOST_MISSES the document starts anew."""
        read = [r for r in read if not r.get("clipped") and r["text"].strip()]
        for row in self.rows:
            row.shown = False
        if sum(len(r["text"]) for r in read) < LEAST_CHARS:
            return "ignored"
        keys = [key(r["text"]) for r in read]
        if not self.rows:
            return self._start(read, keys)
        d = self._offset(keys)
        if d is None and keep_unmatched and not start_over:
            self.misses, self.pieces = 0, self.pieces + 1
            self.rows += [self._row(r, self.pieces, k) for r, k in zip(read, keys)]
            return "merged"
        if d is None:
            self.misses += 1
            return self._start(read, keys) if start_over and self.misses >= MOST_MISSES else "ignored"
        self.misses, self.reads = 0, self.reads + 1
        self._merge(read, keys, d)
        return "merged"

    def _merge(self, read: list[dict], keys: list[str], d: int) -> None:
        """Lays a read over the piece that most of its rows are of. What reaches beyond the piece goes on from it, over
        rows of its neighbours as long as they are the same lines, which makes one piece of both, and else before them."""
        rows = self.rows
        met = Counter(rows[i + d].piece for i, k in enumerate(keys) if 0 <= i + d < len(rows) and rows[i + d].like(k))
        piece = met.most_common(1)[0][0]
        own = {piece}
        first = next(j for j, row in enumerate(rows) if row.piece == piece)
        last = first + sum(1 for _ in takewhile(lambda row: row.piece == piece, rows[first:])) - 1
        laid = [(i + d, self._row(r, piece, k)) for i, (r, k) in enumerate(zip(read, keys))]
        body = rows[first : last + 1]
        for j, row in laid:
            if first <= j <= last:
                # whether a paragraph begins at a read's first row can't be seen
                body[j - first] = replace(row, para=body[j - first].para) if j == d else row

        def onward(fresh: list[Row], old: list[Row]) -> list[Row]:
            """Rows from the piece outward: those of the read, and the neighbours that they don't replace."""
            replaced = 0
            for row in fresh:
                there = old[replaced] if replaced < len(old) else None
                if there and (there.piece in own or there.like(row.key)):
                    own.add(there.piece)
                    replaced += 1
            return fresh + old[replaced:]

        below = onward([row for j, row in laid if j > last], rows[last + 1 :])
        above = onward([row for j, row in reversed(laid) if j < first], rows[:first][::-1])
        self.rows = [replace(row, piece=piece) if row.piece in own and row.piece != piece else row for row in above[::-1] + body + below]

    def document(self) -> list[dict]:
        """All rows; those not shown now without boxes."""
        strip = lambda w: {"start": w["start"], "end": w["end"]}
        return [{"text": r.text, "words": r.words if r.shown else [strip(w) for w in r.words], "para": r.para, "labels": r.labels, "shown": r.shown, "piece": r.piece} for r in self.rows]
