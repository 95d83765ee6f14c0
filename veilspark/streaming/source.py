"""Reads of screens as a data source, and a sink that commits what it writes.

`reads`: a folder of JSON files, each one read (assemble.READ), in the order of their names. As a stream its offset is the
last file and the fingerprint of what it shows, so that a read which shows what the one before it showed is passed over,
and after `still` of them in a row the source stands still: nothing that comes later is taken by a stream of this checkpoint.
At most `most` files are looked at for one batch; a stream that starts again looks through the folder once.

`documents`: each task writes a file of its own beside the table and nothing is seen of it; the driver, when all tasks of a
batch are done, names these files in a manifest, and a reader takes what manifests name. A batch that is written again
replaces its manifest. The folder has to be one that all machines mount.

register(spark) makes both known: spark.readStream.format("reads"), df.writeStream.format("documents")."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from veilspark.streaming.assemble import DOCUMENT, READ

STILL, MOST = 2, 60


class File(InputPartition):
    pass


def _named(folder: str) -> list[str]:
    return sorted(f for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []


def _read(folder: str, name: str) -> dict:
    with open(os.path.join(folder, name)) as f:
        return json.load(f)


def fingerprint(read: dict) -> str:
    """Of what a read shows, by side."""
    return hashlib.sha1(json.dumps([read.get("task_id"), read.get("side"), read.get("header"), read.get("rows")]).encode()).hexdigest()


def _row(read: dict) -> tuple:
    rows = read["rows"]
    return read["task_id"], int(read["seq"]), read["side"], read.get("header"), rows if isinstance(rows, str) else json.dumps(rows)


class Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [File(name) for name in _named(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield _row(_read(self.folder, partition.value))


class Stream(DataSourceStreamReader):
    def __init__(self, folder: str, still: int, most: int):
        self.folder, self.still, self.most = folder, still, most
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "prints": {}, "same": 0}

    def _onward(self, start: dict, until: str | None, most: int | None = None) -> tuple[list[str], dict]:
        """The files that show something new behind an offset, up to one file, and the offset behind them: a function of
        the files alone, so that a batch that is run again reads the same."""
        taken, prints, same, last = [], dict(start["prints"]), start["same"], start["file"]
        for name in [f for f in _named(self.folder) if f > start["file"] and (until is None or f <= until)][:most]:
            if same >= self.still:
                break
            read = _read(self.folder, name)
            side, own = f"{read['task_id']}/{read['side']}", fingerprint(read)
            changed = prints.get(side) != own
            taken += [name] if changed else []
            prints[side], last, same = own, name, 0 if changed else same + 1
        return taken, {"file": last, "prints": prints, "same": same}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = self._onward(self.at, None, self.most)[1] if self.at else self._onward(self.initialOffset(), None)[1]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [File(name) for name in self._onward(start, end["file"])[0]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield _row(_read(self.folder, partition.value))

    def commit(self, end: dict) -> None:
        pass


class Reads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return Stream(self.options["path"], int(self.options.get("still", STILL)), int(self.options.get("most", MOST)))


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class Committing(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Written:
        rows = [r.asDict() for r in iterator]
        if not rows:
            return Written(None, 0)
        os.makedirs(os.path.join(self.folder, "data"), exist_ok=True)
        name = f"{uuid.uuid4().hex}.json"
        with open(os.path.join(self.folder, "data", name), "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        return Written(name, len(rows))

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        os.makedirs(os.path.join(self.folder, "manifests"), exist_ok=True)
        at = os.path.join(self.folder, "manifests", f"{batchId:012d}.json")
        with open(at + ".new", "w") as f:
            json.dump([m.file for m in messages if m and m.file], f)
        os.replace(at + ".new", at)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        for m in messages:
            if m and m.file and os.path.exists(os.path.join(self.folder, "data", m.file)):
                os.remove(os.path.join(self.folder, "data", m.file))


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return DOCUMENT

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return Committing(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Reads)
    spark.dataSource.register(Documents)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """What the sink has committed."""
    manifests = os.path.join(folder, "manifests")
    files = [os.path.join(folder, "data", name) for m in _named(manifests) for name in _read(manifests, m)]
    return spark.read.schema(DOCUMENT).json(files) if files else spark.createDataFrame([], DOCUMENT)


def latest(documents: DataFrame) -> DataFrame:
    """The last row of each task and side."""
    return documents.groupBy("task_id", "side").agg(F.max_by(F.struct(*(c for c in documents.columns if c not in ("task_id", "side"))), "seq").alias("d")).select("task_id", "side", "d.*")
