"""Streams with named state of their own: lifecycle with batch progress, idle heartbeats, sliding throttle, text with resets, and readers that connect late.

Each is a processor of transformWithState: value, map and list states are kept by key in the RocksDB state store, which lies
in the query's checkpoint folder (a shared one), so a query that is started again goes on where it was. Rows of a key are
taken in order of their sequence within a batch.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from inkmill.operators.lifecycle import TRANSITIONS
from inkmill.streaming.lifecycle import read_events

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REPLAY_MOST = 200


def stateful(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "none") -> DataFrame:
    """The processor's rows. Sets the session's state store to RocksDB, which such processors need when a query starts."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.groupBy(key).transformWithState(processor, schema, "append", time)


def derived(statuses: Collection[str]) -> str:
    """A batch's status from its runs' distinct statuses (see operators.ranking.batch_status)."""
    if not statuses:
        return "queued"
    succeeded = "succeeded" in statuses
    if "queued" in statuses or "running" in statuses:
        return "partial" if succeeded else "running"
    return "done" if succeeded else "cancelled" if all(s == "cancelled" for s in statuses) else "failed"


class Lifecycle(StatefulProcessor):
    """Requests for states, forced or not, and progress of runs, which moves the document on by itself.

    In: key, seq, kind ("transition" or "run"), name (the state asked for, or the run), status (of the run), force. Out, for
    each row: from_state, to_state, verdict (no_op, allowed, forced, invalid; null where a run asks for nothing), batch_status and counts so far.
    A document's runs are read from the state once a batch and those that changed written once, as each access is a message to the JVM.
    """

    def __init__(self, start: str, transitions: dict[str, list[str]] = TRANSITIONS, running: str = "ocr_running", partial: str = "ocr_partial", done: str = "ocr_done", failed: str = "ocr_failed"):
        self.start, self.transitions = start, transitions
        self.running, self.targets = running, {"partial": partial, "done": done, "failed": failed, "cancelled": failed}

    def init(self, handle) -> None:
        self.document = handle.getValueState("document", "state string, applied long, ignored long, refused long")
        self.runs = handle.getMapState("runs", "run string", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.document.get() if self.document.exists() else (self.start, 0, 0, 0)
        now, counts = held[0], list(held[1:])
        runs, statuses, changed = None, Counter(), set()
        for r in sorted(rows, key=lambda r: r.seq):
            wanted, batch = r.name, None
            if r.kind == "run":
                if runs is None:
                    runs = {k[0]: v[0] for k, v in self.runs.iterator()}
                    statuses.update(runs.values())
                if r.name in runs:
                    statuses[runs[r.name]] -= 1
                    if not statuses[runs[r.name]]:
                        del statuses[runs[r.name]]
                runs[r.name] = r.status
                statuses[r.status] += 1
                changed.add(r.name)
                batch = derived(statuses)
                wanted = self.targets.get(batch)
                if batch == "partial" and now != self.running:
                    wanted = None  # only the first success moves a running batch
            verdict, before = None, now
            if wanted is not None:
                allowed = wanted in self.transitions.get(now, [])
                verdict = "no_op" if wanted == now else "allowed" if allowed else "forced" if r.force else "invalid"
                counts[0 if verdict in ("allowed", "forced") else 1 if verdict == "no_op" else 2] += 1
                if verdict in ("allowed", "forced"):
                    now = wanted
            yield Row(key=key[0], seq=r.seq, from_state=before, to_state=wanted, state=now, verdict=verdict, batch_status=batch, applied=counts[0], ignored=counts[1], refused=counts[2])
        for name in changed:
            self.runs.updateValue((name,), (runs[name],))
        self.document.update((now, *counts))


def lifecycle(events: DataFrame, key: str, start: str, transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Lifecycle over events with columns key, seq, kind, name, status and force."""
    kind = events.schema[key].dataType.simpleString()
    out = stateful(events, key, Lifecycle(start, transitions), f"key {kind}, seq long, from_state string, to_state string, state string, verdict string, batch_status string, applied long, ignored long, refused long")
    return out.withColumnRenamed("key", key)


class Heartbeats(StatefulProcessor):
    """Frames of a key's events, and a comment frame whenever it has had none for `seconds`: each event moves the key's timer on."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def _wait_from(self, now: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(now + self.wait)
        self.due.update((now + self.wait,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.seq):
            yield Row(key=key[0], seq=r.seq, frame=r.frame)
        self._wait_from(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        self._wait_from(timerValues.getCurrentProcessingTimeInMs())
        yield Row(key=key[0], seq=None, frame=": ping\n\n")


def with_heartbeats(frames: DataFrame, key: str, seconds: float = 15) -> DataFrame:
    """frames: key, seq (a long) and frame. Needs a query that goes on (a trigger by processing time)."""
    kind = frames.schema[key].dataType.simpleString()
    return stateful(frames, key, Heartbeats(seconds), f"key {kind}, seq long, frame string", "processingTime").withColumnRenamed("key", key)


class Throttle(StatefulProcessor):
    """Attempts beyond `most` within the last `seconds`, as operators.lifecycle.throttled counts them.

    Times of attempts are a list state, kept while they can matter: `seconds` and `late` before the latest; with `idle`, a key without
    attempts for so many seconds of processing time is forgotten. A row that comes late counts those before it that are still kept; what was
    decided before stays.
    """

    def __init__(self, most: int, seconds: float, late: float, idle: int | None):
        self.most, self.seconds, self.late, self.idle = most, seconds, late, idle

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "at double", self.idle * 1000 if self.idle else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = sorted(x[0] for x in self.seen.get()) if self.seen.exists() else []
        for at, same in itertools.groupby(sorted(rows, key=lambda r: (r.at, r.seq)), key=lambda r: r.at):
            same = list(same)
            for _ in same:
                bisect.insort(seen, at)
            n = bisect.bisect_right(seen, at) - bisect.bisect_left(seen, at - self.seconds)
            for r in same:
                yield Row(key=key[0], seq=r.seq, in_window=n, throttled=n > self.most)
        self.seen.put([(x,) for x in seen if x >= seen[-1] - self.seconds - self.late])


def throttled(attempts: DataFrame, key: str, most: int = 5, seconds: float = 60, late: float = 60, idle: int | None = None) -> DataFrame:
    """attempts: key, seq (a long) and at (seconds, a double). With idle the query must be one that goes on: batches by processing time have no end."""
    kind = attempts.schema[key].dataType.simpleString()
    return stateful(attempts, key, Throttle(most, seconds, late, idle), f"key {kind}, seq long, in_window long, throttled boolean", "processingTime" if idle else "none").withColumnRenamed("key", key)


class Answer(StatefulProcessor):
    """A text from tokens: "token" appends, "reset" empties, "end" gives the text and forgets it. With each_batch, what there is so far is given too."""

    def __init__(self, each_batch: bool):
        self.each_batch = each_batch

    def init(self, handle) -> None:
        self.tokens = handle.getListState("tokens", "text string")

    def _text(self) -> str:
        return "".join(x[0] for x in self.tokens.get()) if self.tokens.exists() else ""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, seq, open_ = [], None, False
        for r in sorted(rows, key=lambda r: r.seq):
            seq = r.seq
            if r.kind == "token":
                new.append((r.text or "",))
                open_ = True
            elif r.kind == "reset":
                new, open_ = [], True
                self.tokens.clear()
            elif r.kind == "end":
                yield Row(key=key[0], seq=seq, text=self._text() + "".join(x[0] for x in new), ended=True)
                new, open_ = [], False
                self.tokens.clear()
        if new:
            self.tokens.appendList(new)
        if self.each_batch and open_:
            yield Row(key=key[0], seq=seq, text=self._text(), ended=False)


def answers(events: DataFrame, key: str, each_batch: bool = False) -> DataFrame:
    """events: key, seq (a long), kind and text."""
    kind = events.schema[key].dataType.simpleString()
    return stateful(events, key, Answer(each_batch), f"key {kind}, seq long, text string, ended boolean").withColumnRenamed("key", key)


@dataclass
class Connection:
    """What a reader gets: the snapshot first, then what it missed (REPLAY_MOST rows at most), then `tail`, a stream of all after `handover`."""

    snapshot: dict
    replay: DataFrame
    handover: int
    tail: DataFrame


def connect(spark: SparkSession, log: str, schema, key: str, value, seq: str = "seq", status: str = "status", last_seen: int | None = None, most: int = REPLAY_MOST) -> Connection:
    """Connects a reader to one key of an appended log, in which a key's seq rises.

    The snapshot names the last event that it covers. A reader that has seen events before gets those between, in order; if there are
    more than `most`, the tail goes on behind the last of these. Events that arrive after the snapshot come by the tail: nothing
    is missed or given twice.
    """
    own = spark.read.schema(schema).parquet(log).filter(F.col(key) == value)
    now = own.agg(F.max(seq).alias("last_seq"), F.max_by(status, F.when(F.col(status).isNotNull(), F.col(seq))).alias("status"), F.count("*").alias("n_events")).first()
    last = now.last_seq if now.last_seq is not None else -1
    missed = own.filter((F.col(seq) > (last if last_seen is None else last_seen)) & (F.col(seq) <= last)).orderBy(seq).limit(most)
    n, reached = missed.agg(F.count("*"), F.max(seq)).first()
    handover = reached if n == most else last
    tail = read_events(spark, log, schema).filter((F.col(key) == value) & (F.col(seq) > handover))
    return Connection(now.asDict(), missed, handover, tail)
