"""The keyed queue on a stream against a replay in memory, with a restart in between."""

import datetime as dt
import random

from cartolex.streaming import workqueue as wq

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key long, seq long, action string, reason string, at timestamp"


def made(n=400):
    rng = random.Random(2)
    rows, at = [], T0
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 30, 300]))
        rows.append((rng.randint(1, 25), i, rng.choice(["put", "put", "done", "fail", "other"]), rng.choice(["a", "b", None]), at))
    return rows


def replay(rows, wait, most, now):
    log, tasks = [], {}
    for key, _, action, reason, at in sorted(rows, key=lambda r: (r[4], r[1])):
        tasks.setdefault(key, wq.Task(key, wait, most, None)).on(action, reason, at)
    for t in tasks.values():
        t.tick(now)
        log += t.log
    return sorted(map(repr, log))


def test_task_by_hand():
    t = wq.Task(1, 60, 2, None)
    t.on("fail", None, T0)
    t.on("put", "a", T0)
    t.on("put", "b", T0 + dt.timedelta(seconds=10))
    t.on("other", None, T0 + dt.timedelta(seconds=130))
    t.on("done", None, T0 + dt.timedelta(seconds=131))
    assert [(w, r, a, int((at - T0).total_seconds())) for _, w, r, a, at in t.log] == [("queued", "a", 1, 0), ("kept", "b", 1, 10), ("retry", "a", 2, 60), ("given_up", "a", 2, 120)]


def test_stream_equals_a_replay_over_a_restart(spark, tmp_path):
    rows = made()
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    session = wq.stream_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    cuts = [0, 150, 151, len(rows)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # each run starts anew from the checkpoint
        wq.run_queue(session.readStream.schema(SCHEMA).parquet(source), out, state, wait=600.0, most=3, late="0 seconds").awaitTermination()
    got = [(r["key"], r["what"], r["reason"], r["attempts"], r["at"]) for r in session.read.parquet(out).collect()]
    last = max(r[4] for r in rows)
    assert sorted(map(repr, got)) == replay(rows, 600.0, 3, last)
    assert {g[1] for g in got} == {"queued", "kept", "retry", "done", "given_up"}
    tasks = {}
    for key, _, action, reason, at in rows:
        tasks.setdefault(key, wq.Task(key, 600.0, 3, None)).on(action, reason, at)
    for t in tasks.values():
        t.tick(last)
    left = {(r["key"], r["since"], r["attempts"]) for r in wq.open_tasks(session.read.parquet(out)).collect()}
    assert left == {(k, t.state[1], t.state[2]) for k, t in tasks.items() if t.state}
