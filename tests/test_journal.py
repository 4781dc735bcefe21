"""The change log as a stream with state, and the base's manifest."""

import itertools
import random

import pytest

from corpusloom.streaming import journal
from corpusloom.streaming.journal import State, advance


def logs(seed, n=7):
    r = random.Random(seed)
    for k in range(n):
        op = r.choice(("put", "add", "add", "del"))
        yield (k, op, None if op == "del" else f"v{k}", r.choice((None, "p", "q")) if op == "add" else None, r.choice((None, 0, 3)) if op == "add" else None)


@pytest.mark.parametrize("seed", range(20))
def test_every_cut_gives_the_same_state(seed):
    log = list(logs(seed))
    whole = advance(State(), log)
    for bits in itertools.product((0, 1), repeat=len(log) - 1):
        state, part = State(), []
        for record, cut in zip(log, (*bits, 1), strict=True):
            part.append(record)
            if cut:
                state, part = advance(advance(state, part), part), []  # delivered twice
        assert state == whole, bits


def rows(log, ids):
    r = random.Random(len(log))
    return [(op, "c", r.choice(ids), parent, index, rec, line_no) for line_no, op, rec, parent, index in log]


def test_stream_equals_replay_over_a_restart(spark, tmp_path):
    """Cut anywhere, stopped and started again from the checkpoint, with a base and a repeated delivery."""
    log = rows(list(logs(3, 60)), ["a", "b", "c", "d"])
    base = spark.createDataFrame([("c", "a", "base a"), ("c", "k", "base k")], journal.TABLE)
    cuts = [0, 1, 2, 9, 30, 31, 60]
    state, folder = {}, f"{tmp_path}/log"

    def apply(batch, n):
        for r in batch.collect():
            state[(r.t, r.id)] = r

    for k, (i, j) in enumerate(itertools.pairwise(cuts)):
        part = log[i:j] + (log[i:j][:1] if k % 2 else [])
        spark.createDataFrame(part, journal.SCHEMA).coalesce(1).write.mode("append").json(folder)
        if k in (2, 5):  # some files wait for a start
            source = spark.readStream.schema(journal.SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
            query = journal.stream_replay(source, apply, f"{tmp_path}/cp", base=base).start()
            query.processAllAvailable()
            query.stop()
    got = {("c", "k"): "base k"} | {k: r.rec for k, r in state.items() if r.live}
    whole = spark.createDataFrame(log, journal.SCHEMA)
    assert got == {(r.t, r.id): r.rec for r in journal.replay(base, whole).collect()}
    last = {(r.t, r.id): (r.live, r.rec, r.parent, r["index"], r.line_no) for r in journal.last_writes(whole.unionByName(spark.createDataFrame([("put", "c", i, None, None, f"base {i}", -1) for i in "ak"], journal.SCHEMA))).collect()}
    assert {k: tuple(r)[2:] for k, r in state.items()} == {k: v for k, v in last.items() if k in state}


def test_compaction_is_one_commit(spark, tmp_path):
    folder = f"{tmp_path}/base"
    log = spark.createDataFrame(rows(list(logs(5, 40)), ["a", "b", "c"]), journal.SCHEMA)
    assert journal.open_base(spark, folder) is None
    base = journal.commit_base(spark, folder, spark.createDataFrame([("c", "a", "0"), ("c", "z", "9")], journal.TABLE), -1)
    assert journal.open_base(spark, folder) == base and base.line_no == -1
    want = sorted(map(tuple, journal.replayed(base, log).collect()))

    def fail():
        raise RuntimeError("stopped between the table and the manifest")

    first = log.where("line_no < 20")
    with pytest.raises(RuntimeError):
        journal.compact(base, first, before_swap=fail)
    again = journal.open_base(spark, folder)
    assert again == base and sorted(map(tuple, journal.replayed(again, log).collect())) == want

    def fail_late(line_no):
        raise RuntimeError("stopped before the log was cut")

    with pytest.raises(RuntimeError):
        journal.compact(again, first, truncate=fail_late)
    new = journal.open_base(spark, folder)
    assert new.line_no == 19 and new.table != base.table
    assert sorted(map(tuple, journal.replayed(new, log).collect())) == want  # the log still holds what the base has
    assert sorted(map(tuple, journal.replayed(new, log.where("line_no >= 20")).collect())) == want
    cut = []
    last = journal.compact(new, log, truncate=cut.append)
    assert cut == [39] and sorted(map(tuple, last.rows(spark).collect())) == want
    assert journal.compact(last, log) == last  # nothing new, nothing written
    spark.createDataFrame([("c", "x", "1")], journal.TABLE).write.mode("append").parquet(f"{folder}/{last.table}")
    with pytest.raises(ValueError):
        journal.compact(last, log.unionByName(spark.createDataFrame([("put", "c", "n", None, None, "1", 99)], journal.SCHEMA)))


def test_stream_asks_the_store_by_buckets():
    """Python is called once for each bucket of a micro-batch; nulls, and a bucket whose base comes in parts, keep their states."""
    class Handle:
        held = None
        asked = 0

        def getValueState(self, name, schema):
            return self

        def exists(self):
            self.asked += 1
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    import pandas as pd

    p, h = journal._LastWrites(), Handle()
    p.init(h)
    for i in range(2):
        p.handleInitialState((0,), pd.DataFrame({"t": ["c"] * 50, "id": [f"b{i}{k}" for k in range(50)], "rec": [None if k % 7 == 0 else "é\n\"" for k in range(50)]}), None)
    log = [("c", f"b{k % 2}{k % 50}", k, ("put", "add", "del")[k % 3], f"v{k}", None, None if k % 4 else k) for k in range(300)] + [("c", None, 301, "add", None, "p", None)]
    h.asked = 0
    frames = [pd.DataFrame(log[i::2], columns=["t", "id", "line_no", "op", "rec", "parent", "index"]) for i in (1, 0)]
    (out,) = p.handleInputRows((0,), iter(frames), None)
    assert h.asked == 1
    want = {}
    for key in {(r[0], r[1]) for r in log}:
        base = State(True, None if key[1] and int(key[1][2:]) % 7 == 0 else "é\n\"", line_no=-1, seen=-1) if key[1] else State()
        new = advance(base, [(r[2], r[3], r[4], r[5], r[6]) for r in log if r[:2] == key])
        if new.line_no != base.line_no:
            want[key] = (new.live, new.rec, new.parent, new.index, new.line_no)
    got = {tuple(r[:2]): tuple(None if pd.isna(v) else v for v in r[2:]) for r in out.itertuples(index=False)}
    assert got == want and any(v[3] is not None for v in want.values())
    assert not list(p.handleInputRows((0,), iter(frames), None))  # delivered again
