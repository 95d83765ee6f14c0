"""Documents assembled from a stream of reads, with state in columns: a map entry for each row of a document.

The state of a task is not one value that each read parses and writes anew. Rows are entries under numbers of their own,
their order is a list of these numbers, so that a row put in above others changes the list and itself alone; only rows that
a read has changed are written. Bursts are settled by timers in processing time: the last read of each side waits, each
new one puts the timer off, and is laid over the document when the timer runs out.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark.functions.assembly import Assembly, Row
from veilspark.streaming.assemble import _NAMES, DOCUMENT, Task

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIDES = ("left", "right")


class Keeper(StatefulProcessor):
    """wait: milliseconds without a read after which a burst is over; None: every read counts."""

    def __init__(self, start_over: bool = False, wait: int | None = None):
        self.start_over, self.wait = start_over, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "side string, id long", "text string, key string, words string, para boolean, labels string, piece int")
        self.documents = handle.getMapState("documents", "side string", "ids array<long>, shown array<long>, misses int, reads int, pieces int, next long")
        self.task = handle.getValueState("task", "header string, left string, right string, away int, left_on boolean, right_on boolean")
        self.waiting = handle.getMapState("waiting", "side string", "seq long, header string, rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reads = sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["seq"])
        if self.wait is None:
            yield self._laid(key[0], reads)
            return
        for r in reads:
            self.waiting.updateValue((r["side"],), (int(r["seq"]), r["header"], r["rows"]))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield pd.DataFrame(columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reads = [{"side": side, "seq": seq, "header": header, "rows": rows} for (side,), (seq, header, rows) in list(self.waiting.iterator())]
        self.waiting.clear()
        yield self._laid(key[0], sorted(reads, key=lambda r: r["seq"]))

    def close(self) -> None:
        pass

    def _laid(self, name: str, reads: list[dict]) -> pd.DataFrame:
        task, numbers, stored = self._load()
        out = [{"task_id": name, "seq": r["seq"], "side": r["side"], **shown} for r in reads if (shown := task.add(r, self.start_over))]
        self._save(task, numbers, stored)
        return pd.DataFrame(out, columns=_NAMES)

    def _load(self) -> tuple[Task, dict[int, tuple[int, Row]], dict[tuple[str, int], tuple]]:
        """The task, the numbers of its rows (by identity, with the row, so that it lives on), and the entries as they are stored."""
        task, numbers, stored = Task(), {}, {}
        if self.task.exists():
            header, left, right, away, left_on, right_on = self.task.get()
            task.header, task.away = header, away
            task.last = {k: v for k, v in zip(SIDES, (left, right)) if v is not None}
            task.on = {k: v for k, v in zip(SIDES, (left_on, right_on)) if v is not None}
        for side in SIDES:
            if not self.documents.containsKey((side,)):
                continue
            ids, shown, misses, reads, pieces, _ = self.documents.getValue((side,))
            rows = []
            for n in ids:
                entry = tuple(self.rows.getValue((side, n)))
                text, key, words, para, labels, piece = entry
                rows.append(Row(text, key, json.loads(words), para, json.loads(labels), n in set(shown), piece))
                numbers[id(rows[-1])], stored[side, n] = (n, rows[-1]), entry
            task.sides[side] = Assembly(rows, misses, reads, pieces)
        return task, numbers, stored

    def _save(self, task: Task, numbers: dict[int, tuple[int, Row]], stored: dict[tuple[str, int], tuple]) -> None:
        value = lambda d, k: d.get(k)
        self.task.update((task.header, value(task.last, "left"), value(task.last, "right"), task.away, value(task.on, "left"), value(task.on, "right")))
        for side in SIDES:
            a, held = task.sides.get(side), self.documents.containsKey((side,))
            following = self.documents.getValue((side,))[5] if held else 0
            ids = []
            for r in a.rows if a else ():
                n, _ = numbers.get(id(r), (None, None))
                if n is None:
                    n, following = following, following + 1
                entry = (r.text, r.key, json.dumps(r.words), r.para, json.dumps(r.labels), r.piece)
                if stored.get((side, n)) != entry:
                    self.rows.updateValue((side, n), entry)
                ids.append(n)
            for n in {k for s, k in stored if s == side} - set(ids):
                self.rows.removeKey((side, n))
            if a:
                self.documents.updateValue((side,), (ids, [n for n, r in zip(ids, a.rows) if r.shown], a.misses, a.reads, a.pieces, following))
            elif held:
                self.documents.removeKey((side,))


def assemble(reads: DataFrame, start_over: bool = False, wait: int | None = None) -> DataFrame:
    """A stream of READ in, DOCUMENT rows out, as assemble.assemble() has them. Rows with the result "search" say that the
    documents have to be looked for again: see searches()."""
    mode = "None" if wait is None else "ProcessingTime"
    return reads.groupBy("task_id").transformWithStateInPandas(Keeper(start_over, wait), DOCUMENT, "Append", mode)


def searches(documents: DataFrame) -> DataFrame:
    """(task_id, seq) of reads after which a task's documents have to be looked for again."""
    return documents.where("result = 'search'").select("task_id", "seq")
