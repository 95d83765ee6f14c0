"""Documents assembled from a stream of reads: one key for a task, both sides in its state.

A read is (task_id, seq, side, header, rows). A read like the one before it is passed over; another header of at least
four characters begins a new document; a new left document resets the right one; with start_over the left one begins
anew after reads that don't fit it. Reads come in any order of position and nothing expires, so there is no watermark.

snapshots() is the source, debounced() keeps the last of a burst of reads, assemble() the state, shown() the rows of
tasks of which both sides are on the screen, and start() the sink, at intervals or over what is there."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.functions.assembly import Assembly

READ = "task_id string, seq long, side string, header string, rows string"
DOCUMENT = "task_id string, seq long, side string, result string, n_rows long, pieces long, text string, both boolean"
#: How often a live source is looked at, how long a burst of reads lasts, and how many reads a trigger takes.
EVERY, BURST, READS = "1500 milliseconds", "600 milliseconds", 60
#: Reads without text after which the documents have to be looked for again.
AWAY = 4
#: Reads of a batch taken at once, and characters and rows that are given on together.
STEP, MOST_CHARS, MOST_ROWS = 64, 1 << 22, 1 << 12


@dataclass
class Task:
    """What is held of a task: the header, what was last seen of each side, and both documents."""

    header: str = ""
    last: dict[str, str] = field(default_factory=dict)
    away: int = 0
    on: dict[str, bool] = field(default_factory=dict)
    sides: dict[str, Assembly] = field(default_factory=dict)

    def dump(self) -> dict:
        return {"header": self.header, "last": self.last, "away": self.away, "on": self.on, "sides": {k: a.dump() for k, a in self.sides.items()}}

    @classmethod
    def load(cls, d: dict) -> Task:
        return cls(**{**d, "sides": {k: Assembly.load(a) for k, a in d.get("sides", {}).items()}})

    def add(self, read: dict, start_over: bool = False) -> dict | None:
        """One read; rows is a JSON list of rows. Pure, so that a batch and a stream give the same. The right side begins
        anew only together with the left one."""
        header, side = read["header"] or "", read["side"]
        mark = hashlib.sha1(f"{header}|{read['rows']}".encode()).hexdigest()
        if self.last.get(side) == mark:
            return None
        if len(header) >= 4 and header != (self.header or header):
            self.last, self.away, self.on, self.sides = {}, 0, {}, {}
        self.header, self.last[side] = header or self.header, mark
        a = self.sides.setdefault(side, Assembly())
        result = a.add(json.loads(read["rows"]), start_over and side == "left")
        self.away = self.away + 1 if result == "ignored" else 0
        if result == "new" and side == "left":
            self.sides.pop("right", None)
        self.on[side] = result != "ignored"
        if result == "ignored" and self.away != AWAY:
            return None
        return {"result": "search" if self.away == AWAY else result, "n_rows": len(a.rows), "pieces": len({r.piece for r in a.rows}), "text": "\n".join(r.text for r in a.rows), "both": len(self.on) == 2 and all(self.on.values())}


_NAMES = [x.split()[0] for x in DOCUMENT.split(", ")]


def _stepped(task: str, held: dict, reads: list[dict], start_over: bool) -> tuple[dict, pd.DataFrame]:
    own = Task.load(held)
    out = [{"task_id": task, "seq": r["seq"], "side": r["side"], **shown} for r in sorted(reads, key=lambda r: r["seq"]) if (shown := own.add(r, start_over))]
    return own.dump(), pd.DataFrame(out, columns=_NAMES)


def assemble(reads: DataFrame, start_over: bool = False) -> DataFrame:
    """A streaming DataFrame of READ in, DOCUMENT rows out, one for each read that changed something."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        held, out = _stepped(key[0], held, [r for f in frames for r in f.to_dict("records")], start_over)
        state.update((json.dumps(held),))
        if len(out):
            yield out

    return reads.groupBy("task_id").applyInPandasWithState(run, DOCUMENT, "held string", "append", GroupStateTimeout.NoTimeout)


def assemble_batch(reads: DataFrame, start_over: bool = False) -> DataFrame:
    """The same over a finished table: sorted reads run through, of which one task is held at a time."""
    kinds = T.StructType.fromDDL(DOCUMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, task, own = to_arrow_schema(kinds), None, None
        out, size = [], 0
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                for r in b.slice(k, STEP).to_pylist():
                    if own is None or r["task_id"] != task:
                        task, own = r["task_id"], Task()
                    shown = own.add(r, start_over)
                    if shown:
                        out.append({"task_id": task, "seq": r["seq"], "side": r["side"], **shown})
                        size += len(shown["text"])
                    if size >= MOST_CHARS or len(out) >= MOST_ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    asked = reads.select("task_id", "seq", "side", "header", "rows")
    return asked.repartition("task_id").sortWithinPartitions("task_id", "seq").mapInArrow(run, kinds)


def snapshots(spark: SparkSession, folder: str, per_trigger: int = READS) -> DataFrame:
    """A stream of the reads (JSON) that are put into a folder."""
    return spark.readStream.schema(READ).option("maxFilesPerTrigger", per_trigger).json(folder)


def debounced(rows: DataFrame, keys: list[str], time_col: str, gap: str = BURST, late: str = "10 seconds") -> DataFrame:
    """The last row of each burst, rows of equal keys less than gap apart; a batch or a stream, which has a watermark then."""
    timed = rows.withWatermark(time_col, late) if rows.isStreaming else rows
    last = timed.groupBy(*keys, F.session_window(time_col, gap)).agg(F.max_by(F.struct(*rows.columns), time_col).alias("_last"), F.count("*").alias("reads"))
    return last.select("_last.*", "reads")


def shown(documents: DataFrame) -> DataFrame:
    """Rows of tasks of which both sides are to be seen; while either shows something else the last result stands."""
    return documents.where("both and result != 'search'")


def start(documents: DataFrame, path: str, checkpoint: str, every: str | None = EVERY) -> StreamingQuery:
    """Writes a stream of documents as Parquet, at intervals; with every=None what is there now, and then it ends."""
    out = documents.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if every is None else out.trigger(processingTime=every)).start(path)
