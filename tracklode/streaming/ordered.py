"""Keyed state machines over event streams whose rows arrive out of order.

A key's rows wait in state until the watermark has passed them and are then
taken in order of (time, sequence number), so results do not depend on how the
stream was cut into batches or shuffled inside the watermark's delay.  Timers
wake a key for its next waiting row, for a deadline of its own (a time budget)
and when it has been silent, which ends it and frees its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of an ordered stream: the body is JSON text of what a machine reads.
INPUT = "key string, seq bigint, us bigint, body string, ts timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Shared states of a stream's keys; fixed for the life of its checkpoint.
BUCKETS = 2_048


def milliseconds(us: int) -> int:
    """The first millisecond at which the watermark has passed a time."""
    return -(-us // 1000)


class Machine:
    """What happens to one key: its memory is a dict that JSON can hold; results are dicts of the output columns."""

    output = "key string"

    def fresh(self) -> dict:
        return {}

    def take(self, key: str, memory: dict, us: int, seq: int, body: dict) -> list[dict]:
        raise NotImplementedError

    def deadline(self, memory: dict) -> int | None:
        """A time at which something happens if no row has come before."""
        return None

    def time_out(self, key: str, memory: dict) -> list[dict]:
        """The deadline has passed; it must not stand afterwards."""
        return []

    def end(self, key: str, memory: dict) -> list[dict]:
        return []


class Ordered(StatefulProcessor):
    def __init__(self, machine: Machine, silent_ms: int):
        self.machine, self.silent_ms = machine, silent_ms
        self.names = [column.split()[0] for column in machine.output.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, seq bigint, body string")
        self.memory = handle.getValueState("memory", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(u), int(s), b) for r in rows for u, s, b in zip(r["us"], r["seq"], r["body"], strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(milliseconds(min(new)[0]), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made = self.advance(key[0], timerValues.getCurrentWatermarkInMs())
        if made:
            yield pd.DataFrame([[r.get(n) for n in self.names] for r in made], columns=self.names, dtype=object)

    def advance(self, key: str, now: int) -> list[dict]:
        """Everything up to the watermark."""
        if not self.memory.exists() and not self.waiting.exists():
            return []  # ended by an earlier timer of the same batch
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else self.machine.fresh()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        made, rest, memory, wake = self.step(key, memory, rows, now)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if memory is None:
            self.memory.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return made
        self.memory.update((json.dumps(memory, ensure_ascii=False),))
        self.handle.registerTimer(wake)
        return made

    def step(self, key: str, memory: dict, rows: list[tuple], now: int) -> tuple[list[dict], list[tuple], dict | None, int | None]:
        """Results of a key up to the watermark, the rows that still wait, its memory (None: it has ended) and when to wake it."""
        machine, made = self.machine, []
        due = [r for r in rows if milliseconds(r[0]) <= now]
        rest = rows[len(due) :]
        for us, seq, body in due:
            limit = machine.deadline(memory)
            if limit is not None and us > limit * 1000:
                made += machine.time_out(key, memory)
            made += machine.take(key, memory, us, seq, json.loads(body))
            memory["last_ms"] = milliseconds(us)
        limit = machine.deadline(memory)
        if limit is not None and now >= limit:
            made += machine.time_out(key, memory)
            limit = machine.deadline(memory)
        silent = memory["last_ms"] + self.silent_ms if "last_ms" in memory else None
        if not rest and silent is not None and now >= silent:
            made += machine.end(key, memory)
            return made, [], None, None
        return made, rest, memory, min(t for t in (milliseconds(rest[0][0]) if rest else None, limit, silent) if t is not None and t > now)


class Bucketed(Ordered):
    """Many keys that share one state and one timer.

    Each call to the state store is a message to the JVM and back, so a state
    for each key costs a batch dozens of them a key.  A bucket's keys are taken
    one after the other, each by its own rows and memory, as if it were alone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, us bigint, seq bigint, body string")
        self.memory = handle.getValueState("memory", "text string")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(k, int(u), int(s), b) for r in rows for k, u, s, b in zip(r["key"], r["us"], r["seq"], r["body"], strict=True)]
        self.waiting.appendList(new)
        at = max(milliseconds(min(r[1] for r in new)), timerValues.getCurrentWatermarkInMs() + 1)
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))
        return iter(())

    def advance(self, bucket, now: int) -> list[dict]:
        memories = json.loads(self.memory.get()[0]) if self.memory.exists() else []
        memories = {k: m for k, m in memories}  # pairs, as a key may be null
        waiting: dict[str | None, list[tuple]] = {k: [] for k in memories}
        for k, *row in self.waiting.get() if self.waiting.exists() else ():
            waiting.setdefault(k, []).append(tuple(row))
        made, left, kept, wakes = [], [], [], []
        for k, rows in waiting.items():
            found, rest, memory, wake = self.step(k, memories.get(k) or self.machine.fresh(), sorted(rows), now)
            made += found
            left += [(k, *r) for r in rest]
            if memory is not None:
                kept.append((k, memory))
                wakes.append(wake)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if kept:
            self.memory.update((json.dumps(kept, ensure_ascii=False),))
            self.handle.registerTimer(min(wakes))
            self.timer.update((min(wakes),))
        else:
            self.memory.clear()
            self.timer.clear()
        return made


def ordered_rows(stream: DataFrame, key: Column, seq: Column, ts: Column, body: Column, late: str) -> DataFrame:
    """INPUT rows of a stream with a watermark on ``ts``; ``body`` is a struct."""
    time = ts.cast("timestamp")
    rows = stream.select(key.cast("string").alias("key"), F.coalesce(seq.cast("bigint"), F.lit(0)).alias("seq"), F.unix_micros(time).alias("us"), F.to_json(body).alias("body"), time.alias("ts"))
    return rows.withWatermark("ts", late)


def run(rows: DataFrame, machine: Machine, silent_ms: int = 30 * DAY_MS, buckets: int = BUCKETS) -> DataFrame:
    """Results of a machine over ``ordered_rows``; the session's state store must be RocksDB (``STORE``)."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Bucketed(machine, silent_ms), machine.output, "append", "eventTime")


class Budget(Machine):
    """Where a key's running sums first reach a limit: ``seq`` and the first used-up column in the order given; or the time budget runs out before its end.

    The body holds the named numbers, and ``final`` on the row that ends a key.
    """

    output = "key string, seq bigint, reason string"

    def __init__(self, limits: dict[str, float], seconds: float | None = None):
        self.limits, self.seconds = limits, seconds

    def fresh(self) -> dict:
        return {"sums": dict.fromkeys(self.limits, 0), "stopped": False}

    def take(self, key, memory, us, seq, body):
        memory.setdefault("first_ms", milliseconds(us))
        if memory["stopped"]:
            return []
        for name in self.limits:
            memory["sums"][name] += body.get(name) or 0
        used = next((n for n, limit in self.limits.items() if memory["sums"][n] >= limit), None)
        memory["stopped"] = used is not None or bool(body.get("final"))
        return [{"key": key, "seq": seq, "reason": used}] if used else []

    def deadline(self, memory):
        return None if self.seconds is None or memory["stopped"] or "first_ms" not in memory else memory["first_ms"] + int(self.seconds * 1000)

    def time_out(self, key, memory):
        memory["stopped"] = True
        return [{"key": key, "seq": None, "reason": "seconds"}]


class EarlyAnswers(Machine):
    """The first answer of a key, if it comes before so many rounds and seconds: it is sent back, once.

    The body holds ``kind``.
    """

    output = "key string, round bigint, elapsed bigint"

    def __init__(self, min_rounds: int, min_seconds: float):
        self.min_rounds, self.min_seconds = min_rounds, min_seconds

    def fresh(self) -> dict:
        return {"round": 0, "answered": False}

    def take(self, key, memory, us, seq, body):
        first = memory.setdefault("first_us", us)
        memory["round"] += 1
        if memory["answered"] or body.get("kind") != "answer":
            return []
        memory["answered"] = True
        elapsed = (us - first) // 1_000_000
        return [{"key": key, "round": memory["round"], "elapsed": elapsed}] if memory["round"] < self.min_rounds and elapsed < self.min_seconds else []
