"""Typed state against the plain one, read by read, with what is written of it; timers; the source of reads and its sink."""

import json
import os
import random

import pandas as pd
import pytest

from veilspark.streaming import assemble, keeper, source


def made_reads(seed, tasks=3, n=14):
    rng, reads, seq = random.Random(seed), [], 0
    for t in range(tasks):
        docs = {s: [f"line {k} of {s} {rng.choice(['river', 'stone', 'cloud'])} number {rng.randint(0, 10**6)}" for k in range(30)] for s in keeper.SIDES}
        for _ in range(n):
            side, at = rng.choice(keeper.SIDES), rng.randint(0, 25)
            rows = [{"text": x, "words": [], "para": rng.random() < 0.2} for x in docs[side][at : at + rng.randint(1, 8)]] if rng.random() < 0.85 else [{"text": "x", "words": [], "para": False}]
            seq += 1
            reads.append({"task_id": f"t{t}", "seq": seq, "side": side, "header": rng.choice(["", "file one.txt", "file one.txt", "another.txt"]) if rng.random() < 0.3 else "", "rows": json.dumps(rows)})
    return reads


class Map:
    def __init__(self):
        self.d, self.writes = {}, []

    def getValue(self, k):  # noqa: N802
        return self.d.get(k)

    def containsKey(self, k):  # noqa: N802
        return k in self.d

    def updateValue(self, k, v):  # noqa: N802
        self.d[k] = v
        self.writes.append(k)

    def removeKey(self, k):  # noqa: N802
        self.d.pop(k, None)

    def iterator(self):
        return iter(self.d.items())

    def clear(self):
        self.d = {}


class Value:
    v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Handle:
    def __init__(self):
        self.timers, self.maps = [], {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, Map())

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def plain(reads, start_over=False):
    out, held = [], {}
    for r in reads:
        task = assemble.Task.load(held.get(r["task_id"], {}))
        if shown := task.add(r, start_over):
            out.append({"task_id": r["task_id"], "seq": r["seq"], "side": r["side"], **shown})
        held[r["task_id"]] = json.loads(json.dumps(task.dump()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_state_in_columns_is_the_plain_one(seed):
    reads, out = [r for r in made_reads(seed, 1, 40)], []
    handle, k = Handle(), keeper.Keeper(seed % 2 == 0)
    k.init(handle)
    for r in reads:
        for frame in k.handleInputRows((r["task_id"],), iter([pd.DataFrame([r])]), Now(0)):
            out += frame.to_dict("records")
    assert out == plain(reads, seed % 2 == 0) and len(out) > 15


def test_only_changed_rows_are_written():
    lines = [{"text": f"line {i} of the long document here", "words": [], "para": False} for i in range(60)]
    read = lambda seq, a, z: pd.DataFrame([{"task_id": "t", "seq": seq, "side": "left", "header": "", "rows": json.dumps(lines[a:z])}])
    handle, k = Handle(), keeper.Keeper()
    k.init(handle)
    wrote = handle.maps["rows"].writes
    for seq, (a, z) in enumerate([(20, 40), (30, 50), (10, 25), (0, 12)]):
        before = len(wrote)
        list(k.handleInputRows(("t",), iter([read(seq, a, z)]), Now(0)))
        assert len(wrote) - before <= z - a  # rows of the read alone, wherever they are put in
    assert len(handle.maps["rows"].d) == 50


def test_a_burst_waits_for_its_timer():
    lines = [{"text": f"line {i} of the long document here", "words": [], "para": False} for i in range(30)]
    read = lambda seq, a: pd.DataFrame([{"task_id": "t", "seq": seq, "side": "left", "header": "", "rows": json.dumps(lines[a : a + 10])}])
    handle, k = Handle(), keeper.Keeper(wait=600)
    k.init(handle)
    for seq, (a, now) in enumerate([(0, 0), (5, 200), (8, 700)]):
        assert [len(f) for f in k.handleInputRows(("t",), iter([read(seq, a)]), Now(now))] == [0]
    assert handle.timers == [1300]
    shown = [r for f in k.handleExpiredTimer(("t",), Now(1300), None) for r in f.to_dict("records")]
    assert [(r["seq"], r["result"], r["n_rows"]) for r in shown] == [(2, "new", 10)] and shown[0]["text"].startswith("line 8 ")
    assert [len(f) for f in k.handleExpiredTimer(("t",), Now(9999), None)] == [0]


def put(folder, reads, start=0):
    os.makedirs(folder, exist_ok=True)
    for k, r in enumerate(reads, start):
        with open(f"{folder}/{k:06d}.json", "w") as f:
            json.dump(r, f)


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keeper.PROVIDER)
    source.register(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ran(df, at, checkpoint):
    q = df.writeStream.format("documents").option("path", at).option("checkpointLocation", checkpoint).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_stream_of_reads_to_committed_documents(stateful, tmp_path):
    reads = made_reads(9, 2, 10)
    put(f"{tmp_path}/in", reads[:12])
    stream = lambda: keeper.assemble(stateful.readStream.format("reads").option("path", f"{tmp_path}/in").option("still", 1000).load())
    ran(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    put(f"{tmp_path}/in", reads[12:], 12)
    ran(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")  # goes on where it was
    got = source.committed(stateful, f"{tmp_path}/out").collect()
    key = lambda r: (r["task_id"], r["seq"])
    assert sorted((r.asDict() for r in got), key=key) == sorted(plain(reads), key=key)
    batch = assemble.assemble_batch(stateful.read.format("reads").option("path", f"{tmp_path}/in").load())
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, got))
    assert {r.seq for r in keeper.searches(source.committed(stateful, f"{tmp_path}/out")).collect()} == {r["seq"] for r in plain(reads) if r["result"] == "search"}
    assert source.latest(source.committed(stateful, f"{tmp_path}/out")).count() == len({(r["task_id"], r["side"]) for r in plain(reads)})


def test_source_stands_still_after_unchanged_reads(tmp_path):
    one = lambda k: {"task_id": "t", "seq": k, "side": "left", "header": "", "rows": [{"text": f"row {k}"}]}
    seen = [one(0), one(1), one(1), one(2), one(2), one(2), one(3)]
    put(f"{tmp_path}/in", [{**r, "seq": k} for k, r in enumerate(seen)])
    s = source.Stream(f"{tmp_path}/in", 2, 60)
    start, end = s.initialOffset(), s.latestOffset()
    assert [p.value for p in s.partitions(start, end)] == ["000000.json", "000001.json", "000003.json"]
    assert end["file"] == "000005.json" and s.latestOffset() == end and source.Stream(f"{tmp_path}/in", 2, 60).latestOffset() == end
    assert s.partitions(end, end) == [] and source.Stream(f"{tmp_path}/none", 2, 60).latestOffset()["file"] == ""


def test_sink_shows_what_is_committed(spark, tmp_path):
    from pyspark.sql import Row

    w = source.Committing(f"{tmp_path}/out")
    row = Row(task_id="t", seq=1, side="left", result="new", n_rows=1, pieces=1, text="x", both=False)
    lost, kept = w.write(iter([row])), w.write(iter([row, row]))
    assert source.committed(spark, f"{tmp_path}/out").count() == 0
    w.abort([lost, None], 0)
    w.commit([kept, None, w.write(iter([]))], 0)
    w.commit([kept], 0)
    assert source.committed(spark, f"{tmp_path}/out").count() == 2 and len(os.listdir(f"{tmp_path}/out/data")) == 1
