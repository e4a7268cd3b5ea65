"""Streams with keyed state of their own: the sliding-log limiter, and conversation memory with rolling summaries.

Each operator is a fold over the rows of a key in order, told here as plain steps. ``limited`` and ``remembered``
run the steps over a table; ``limited_stream`` and ``remembered_stream`` run the same steps over a stream, with the
fold's state in Spark's state store and event-time timers that clear what is out of date. So a stream gives
the rows of the table, however it is cut into batches and wherever it is started again from its checkpoint, as long
as no row is later than the watermark allows.

A key's rows depend on those before them, so they are one task's; it holds the rows of a key in one batch of the
stream and the state: ``limit`` times, or a window under the summary's thresholds. Tables are walked in sorted order.

Defined cases: null keys are one key; rows alike in key and time keep the order of their ids; a message whose id is
not above the last one of its conversation has come before and is passed over; a null text is empty; what a summary
function gives as null or empty, or raises, leaves the window as it is, to be tried at the next message.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Takes the old summary and the (role, text) of messages; gives the new summary.
Summarise = Callable[[str, list[tuple[str, str]]], str | None]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(df: DataFrame) -> DataFrame:
    """Sets the state store that keyed state with timers needs, for queries that start from now on."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df


# The limiter


def admitted(taken: list[int], at: int, limit: int, window_ms: int) -> tuple[bool, int, int]:
    """Whether a request passes, how many more may, and how long to wait if it does not. Drops times out of the window from ``taken`` and adds those that pass."""
    while taken and taken[0] <= at - window_ms:
        taken.pop(0)
    if ok := len(taken) < limit:
        taken.append(at)
    return ok, max(0, limit - len(taken)), 0 if ok else window_ms


_ADMITTED = ["allowed", "remaining", "retry_after_ms"]


def _keyed(requests: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """Keys without nulls beside a mark for them, so that rows of a null key are together."""
    columns = [F.col(order).cast("long").alias("seq"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("who"), F.col(key).isNull().alias("nobody"), F.col(at).cast("long").alias("at_ms")]
    return requests.select(*columns, *([F.col("ts")] if "ts" in requests.columns else []))


def _named(out: DataFrame, key: str, at: str, order: str) -> DataFrame:
    return out.select(F.col("seq").alias(order), F.when(~F.col("nobody"), F.col("who")).alias(key), F.col("at_ms").alias(at), *_ADMITTED)


_LIMITED = "seq long, who long, nobody boolean, at_ms long, allowed boolean, remaining int, retry_after_ms long"
_LIMITED_NAMES = ["seq", "who", "nobody", "at_ms", *_ADMITTED]


def limited(requests: DataFrame, key: str = "user_id", at: str = "ms", order: str = "event_id", limit: int = 60, window_ms: int = 60_000) -> DataFrame:
    """Sliding-log limiter: a request passes if fewer than ``limit`` passed in the window before it; only those count. A refused one waits a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken = None, []
        for pdf in batches:
            out = []
            for i, k, null, t in zip(pdf["seq"].tolist(), pdf["who"].tolist(), pdf["nobody"].tolist(), pdf["at_ms"].tolist(), strict=True):
                if (k, null) != now:
                    now, taken = (k, null), []
                out.append((i, k, null, t, *admitted(taken, t, limit, window_ms)))
            yield pd.DataFrame(out, columns=_LIMITED_NAMES)

    rows = _keyed(requests, key, at, order).drop("ts")
    return _named(rows.repartition("who", "nobody").sortWithinPartitions("nobody", "who", "at_ms", "seq").mapInPandas(run, _LIMITED), key, at, order)


class Limiter(StatefulProcessor):
    """State: the accepted times of a key, in order. A timer clears them a window after the last."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        taken = [int(t) for t in self.taken.get()[0]] if self.taken.exists() else []
        timer, out = taken[-1] + self.window_ms if taken else None, []
        for i, t in zip(pdf["seq"].tolist(), pdf["at_ms"].tolist(), strict=True):
            out.append((i, key[0], key[1], t, *admitted(taken, t, self.limit, self.window_ms)))
        if timer is not None:
            self.handle.deleteTimer(timer)
        if taken:
            self.taken.update((taken,))
            self.handle.registerTimer(taken[-1] + self.window_ms)
        yield pd.DataFrame(out, columns=_LIMITED_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.taken.clear()
        yield pd.DataFrame([], columns=_LIMITED_NAMES)

    def close(self) -> None:
        return


def limited_stream(requests: DataFrame, key: str = "user_id", at: str = "ms", order: str = "event_id", limit: int = 60, window_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """``limited`` over a stream with a timestamp ts; at is the same time in milliseconds."""
    rows = with_store(_keyed(requests.withWatermark("ts", late), key, at, order))
    out = rows.groupBy("who", "nobody").transformWithStateInPandas(Limiter(limit, window_ms), _LIMITED, "append", "EventTime")
    return _named(out, key, at, order)


# Memory


def tokens(text: str) -> int:
    """As tokens_of_memory: wide characters count one, four others one, rounded up."""
    wide = sum("⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" for c in text)
    return wide + (len(text) - wide + 3) // 4


@dataclass
class Memory:
    """A conversation's window of messages since its last summary, the mark that a summary stands before them, the summary and its watermark."""

    ids: list[int] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    marked: bool = False
    summary: str = ""
    watermark: int = -1
    newest: int = -1
    touched: int = 0

    def expired(self, conv_id: int, at: int, ttl_ms: int) -> list[tuple]:
        """The window goes when nothing was written for ttl_ms; the summary and the watermark stay, so messages above it can be restored."""
        if at - self.touched < ttl_ms or not (self.ids or self.marked):
            return []
        out = [(conv_id, self.newest, "expired", self.watermark, len(self.ids), None)]
        self.ids, self.roles, self.texts, self.marked = [], [], [], False
        return out

    def add(self, conv_id: int, message: int, at: int, role: str, text: str | None, rules: Rules) -> list[tuple]:
        if message <= self.newest:
            return []
        out = self.expired(conv_id, at, rules.ttl_ms)
        self.ids, self.roles, self.texts = [*self.ids, message], [*self.roles, role or ""], [*self.texts, text or ""]
        self.newest, self.touched = message, at
        if len(self.ids) + self.marked < rules.most and sum(map(tokens, self.texts)) < rules.tokens:
            return out
        try:
            made = rules.summarise(self.summary, list(zip(self.roles, self.texts, strict=True)))
        except Exception:  # noqa: BLE001  a model that fails is tried again at the next message
            made = None
        if not made:
            return [*out, (conv_id, message, "failed", self.watermark, len(self.ids), None)]
        self.summary, self.watermark, n = made, max(self.ids), len(self.ids)
        self.ids, self.roles, self.texts, self.marked = [], [], [], True
        return [*out, (conv_id, message, "rolled", self.watermark, n, made)]


@dataclass(frozen=True)
class Rules:
    """When a window is summed up (so many entries, the mark among them, or so many tokens), by what, and how long an idle one stays."""

    summarise: Summarise
    most: int = 8
    tokens: int = 2500
    ttl_ms: int = 7 * 86_400_000


_REMEMBERED = "conv_id long, id long, kind string, watermark long, messages long, summary string"
_REMEMBERED_NAMES = ["conv_id", "id", "kind", "watermark", "messages", "summary"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_REMEMBERED_NAMES)


def _messages(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("conv_id").cast("long"), F.col("id").cast("long"), F.col("ms").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *([F.col("ts")] if "ts" in messages.columns else [])).filter("conv_id is not null and id is not null")


def remembered(messages: DataFrame, rules: Rules, until_ms: int | None = None) -> DataFrame:
    """messages: (conv_id, id, ms, role, text). A row for each time that a window was summed up (rolled), could not be (failed) or was dropped (expired; after the last message only up to until_ms)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, memory = None, Memory()

        def ended() -> list[tuple]:
            return memory.expired(now, until_ms, rules.ttl_ms) if now is not None and until_ms is not None else []

        for pdf in batches:
            out = []
            for c, i, t, role, text in zip(*(pdf[x].tolist() for x in ("conv_id", "id", "ms", "role", "text")), strict=True):
                if c != now:
                    out += ended()
                    now, memory = c, Memory()
                out += memory.add(c, i, t, role, text, rules)
            yield _frame(out)
        yield _frame(ended())

    return _messages(messages).drop("ts").repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInPandas(run, _REMEMBERED)


class Conversations(StatefulProcessor):
    """State: a conversation's Memory. A timer drops an idle window."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", "ids array<long>, roles array<string>, texts array<string>, marked boolean, summary string, watermark long, newest long, touched long")

    def held(self) -> Memory:
        if not self.state.exists():
            return Memory()
        ids, roles, texts, *rest = self.state.get()
        return Memory([int(i) for i in ids], list(roles), list(texts), *rest)

    def put(self, memory: Memory) -> None:
        self.state.update((memory.ids, memory.roles, memory.texts, memory.marked, memory.summary, memory.watermark, memory.newest, memory.touched))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory, out = self.held(), []
        timer = memory.touched + self.rules.ttl_ms if memory.newest >= 0 else None
        pdf = pd.concat(list(rows)).sort_values("id")
        for i, t, role, text in zip(*(pdf[x].tolist() for x in ("id", "ms", "role", "text")), strict=True):
            out += memory.add(key[0], i, t, role, text, self.rules)
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(memory.touched + self.rules.ttl_ms)
        self.put(memory)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        memory = self.held()
        out = memory.expired(key[0], expiredTimerInfo.getExpiryTimeInMs(), self.rules.ttl_ms)
        self.put(memory)
        yield _frame(out)

    def close(self) -> None:
        return


def remembered_stream(messages: DataFrame, rules: Rules, late: str = "0 seconds") -> DataFrame:
    """``remembered`` over a stream with a timestamp ts; ms is the same time in milliseconds."""
    rows = with_store(_messages(messages.withWatermark("ts", late)))
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversations(rules), _REMEMBERED, "append", "EventTime")
