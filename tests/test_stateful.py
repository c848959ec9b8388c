"""Stateful streams against plain versions, across restarts and pauses."""

import random
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from inkmill.operators import lifecycle as M
from inkmill.plans.conversation import STATES
from inkmill.streaming import lifecycle as L
from inkmill.streaming import stateful as S

REQUESTS = "user_id long, seq long, kind string, name string, status string, force boolean, ts timestamp"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_lifecycle_goes_on_after_a_restart(spark, tmp_path):
    """Two runs of one query over a log that grows, with its checkpoint: equal to the replay of all."""
    rng, now = random.Random(4), None
    rows = [(rng.randrange(5), i, "transition", rng.choice(list(STATES)), None, rng.random() < 0.2, now) for i in range(200)]
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    for part in (rows[:90], rows[90:150], rows[150:]):
        put(spark, log, part, REQUESTS)
        stream = S.lifecycle(L.read_events(spark, log, REQUESTS), "user_id", "signup", STATES)
        L.append_events(stream, out, state).awaitTermination()  # a new query each time
    got = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("state", "applied", "ignored", "refused"), "seq").alias("r"), F.count("*").alias("n")).select("user_id", "r.*", "n")
    whole = spark.createDataFrame(rows, REQUESTS).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("name").alias("state"), "force"))).alias("log"), F.count("*").alias("n"))
    want = whole.select("user_id", M.replay(F.col("log"), "signup", STATES).alias("r"), "n").select("user_id", "r.*", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batch_progress_moves_the_document(spark, tmp_path):
    run = lambda i, name, status: (1, i, "run", name, status, False, None)
    rows = [run(1, "a", "running"), run(2, "b", "running"), run(3, "a", "succeeded"), run(4, "c", "queued"), run(5, "b", "failed"), run(6, "c", "cancelled"), (1, 7, "transition", "indexed", None, False, None), (1, 8, "transition", "indexed", None, True, None)]
    for n, part in enumerate((rows[:4], rows[4:])):
        put(spark, str(tmp_path / "log"), part, REQUESTS)
    stream = S.lifecycle(L.read_events(spark, str(tmp_path / "log"), REQUESTS), "user_id", "ocr_running")
    L.append_events(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [(r.seq, r.batch_status, r.verdict, r.state) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == [
        (1, "running", None, "ocr_running"), (2, "running", None, "ocr_running"), (3, "partial", "allowed", "ocr_partial"), (4, "partial", None, "ocr_partial"),
        (5, "partial", None, "ocr_partial"), (6, "done", "allowed", "ocr_done"), (7, None, "invalid", "ocr_done"), (8, None, "forced", "indexed"),
    ]


class Kept(dict):
    """States in memory that count how often they are asked."""

    asked = 0

    def getValueState(self, name, *schemas):
        return self.setdefault(name, Kept())

    getMapState = getValueState

    def _ask(self):
        self.asked += 1

    def exists(self):
        self._ask()
        return bool(self)

    def get(self):
        self._ask()
        return self["value"]

    def update(self, value):
        self._ask()
        self["value"] = value

    def updateValue(self, key, value):
        self._ask()
        self[key] = value

    def iterator(self):
        self._ask()
        return iter(list(self.items()))

    def values(self):
        self._ask()
        return list(super().values())


def test_state_is_asked_by_batch_and_not_by_row():
    """With many rows of a document in one batch the runs are read once and each is written once; rows come out as one batch a row gives them."""
    rng = random.Random(7)
    kinds = [("run", f"r{rng.randrange(4)}", rng.choice(["queued", "running", "succeeded", "failed", "cancelled", None])) if rng.random() < 0.8 else ("transition", "ocr_running", None) for _ in range(500)]
    rows = [Row(seq=i, kind=k, name=n, status=s, force=False) for i, (k, n, s) in enumerate(kinds)]

    def given(parts):
        states, p, out = Kept(), S.Lifecycle("ocr_running"), []
        p.init(states)
        for part in parts:
            out += p.handleInputRows((1,), part, None)
        return out, states

    (whole, states), (single, others) = given([rows]), given([[r] for r in rows])
    assert whole == single and states["runs"] == others["runs"]
    latest, want = {}, []
    for kind, name, status in kinds:
        latest |= {name: status} if kind == "run" else {}
        want.append(S.derived(list(latest.values())) if kind == "run" else None)
    assert [r.batch_status for r in whole] == want
    assert states["runs"].asked <= 5 and states["document"].asked <= 3


def test_heartbeats_come_in_pauses_only(spark, tmp_path):
    """Gaps shorter than the interval give none; longer ones do, and each event puts the next one off."""
    schema = "user_id long, seq long, frame string, ts timestamp"
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    put(spark, log, [(1, 0, "data: 0\n\n", None)], schema)
    frames = S.with_heartbeats(L.read_events(spark, log, schema).select("user_id", "seq", "frame"), "user_id", 8)
    query = L.append_events(frames, out, str(tmp_path / "state"), interval="500 milliseconds")
    shown = lambda: [(r.seq, r.frame) for r in spark.read.schema("user_id long, seq long, frame string").parquet(out).collect()]

    def wait(test, seconds):
        end = time.time() + seconds
        while time.time() < end and not test():
            assert query.exception() is None
            time.sleep(0.3)
        return test()

    try:
        assert wait(lambda: len(shown()) >= 1, 60)
        for i in (1, 2, 3):  # each comes less than eight seconds after the last
            put(spark, log, [(1, i, f"data: {i}\n\n", None)], schema)
            assert wait(lambda i=i: (i, f"data: {i}\n\n") in shown(), 30)
        early = [x for x in shown() if x[0] is None]
        assert wait(lambda: len([x for x in shown() if x[0] is None]) >= len(early) + 2, 60)
    finally:
        query.stop()
    pings = [x for x in shown() if x[0] is None]
    assert {f for _, f in pings} == {": ping\n\n"} and len(early) <= 1 and sorted(s for s, _ in shown() if s is not None) == [0, 1, 2, 3]


def test_throttle_over_batches_and_late_rows(spark, tmp_path):
    schema = "user_id long, seq long, at double, ts timestamp"
    rng = random.Random(2)
    rows = sorted(((rng.randrange(3), i, float(rng.randrange(400)), None) for i in range(150)), key=lambda r: r[2])
    batches, log = [rows[i : i + 40] for i in range(0, 150, 40)], str(tmp_path / "log")
    # Ties lie in one batch, as a batch's rows are known together.
    for k in range(len(batches) - 1):
        while batches[k + 1] and batches[k + 1][0][2] == batches[k][-1][2]:
            batches[k].append(batches[k + 1].pop(0))
    late = [(0, 1000, batches[-1][-1][2] - 50.0, None)]
    for part in [*batches, late]:
        put(spark, log, part, schema)
    stream = S.throttled(L.read_events(spark, log, schema).select("user_id", "seq", "at"), "user_id", seconds=60, late=60)
    L.append_events(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.seq: (r.in_window, r.throttled) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    count = lambda u, at: sum(r[0] == u and at - 60 <= r[2] <= at for r in rows)
    assert got == {s: (n := count(u, at), n > 5) for u, s, at, _ in rows} | {1000: (n := count(0, late[0][2]) + 1, n > 5)}


def test_answers_end_and_start_anew(spark, tmp_path):
    schema = "user_id long, seq long, kind string, text string, ts timestamp"
    rows = [(1, 1, "token", "wrong ", None), (1, 2, "reset", None, None), (1, 3, "token", "ri", None), (2, 1, "token", None, None), (1, 4, "token", "ght", None), (1, 5, "end", None, None), (2, 2, "end", None, None), (1, 6, "token", "next", None), (1, 7, "end", None, None)]
    for i in range(0, len(rows), 2):
        put(spark, str(tmp_path / "log"), rows[i : i + 2], schema)
    stream = S.answers(L.read_events(spark, str(tmp_path / "log"), schema), "user_id")
    L.append_events(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.user_id, r.seq, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5, "right"), (1, 7, "next"), (2, 2, "")]


def test_readers_that_missed_much(spark, tmp_path):
    """With more missed events than are replayed the tail goes on behind them; nothing is lost or given twice."""
    schema, log = "user_id long, seq long, status string, ts timestamp", str(tmp_path / "log")
    put(spark, log, [(i % 2, i, None if i % 5 else f"s{i}", None) for i in range(1000)], schema)
    c = S.connect(spark, log, schema, "user_id", 1, last_seen=101)
    assert c.snapshot == {"last_seq": 999, "status": "s995", "n_events": 500} and c.handover == 501
    replay = [r.seq for r in c.replay.collect()]
    put(spark, log, [(i % 2, i, "new", None) for i in range(1000, 1010)], schema)
    tail = [r.seq for r in L.drain(c.tail.select("seq"), "append", str(tmp_path / "tail")).collect()]
    assert replay == list(range(103, 502, 2)) and sorted(tail) == list(range(503, 1010, 2))
    new = S.connect(spark, log, schema, "user_id", 1)
    assert new.replay.count() == 0 and new.handover == 1009
    nobody = S.connect(spark, log, schema, "user_id", 77, last_seen=5)
    assert nobody.handover == -1 and nobody.replay.count() == 0
