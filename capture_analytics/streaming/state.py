"""Keyed state over streams: selector probation, chat turns and run time limits.

The state of a key is small, lives in RocksDB and ends: with the turn or run it belongs to, or, if that
end never comes, after a time to live. Of the rows only the columns that the state needs are kept,
and `queues.files` bounds the bytes of a micro-batch.

What depends on the order of events keeps rows until the watermark has passed them and applies them in
their own order then, so it does not matter in which batch a row arrives, or which rows a replay puts
together. Chat turns are sorted within a micro-batch by their sequence number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capture_analytics.functions.chat import TOOL_RELOADS
from capture_analytics.operators.profiles import PROBATION
from capture_analytics.operators.traces import LINK_SECONDS, RUN_CAP_SECONDS

PROBATION_OUT = "host string, event_id bigint, graduated string, candidate string, matches int"
USAGE = ("request_tokens", "response_tokens", "total_tokens", "requests")
CHAT_OUT = "conv_id bigint, turn bigint, kind string, value string, " + ", ".join(
    f"{c} bigint" for c in USAGE)
# How long state is kept for a turn that never ends, and a mark for rows after a run's end.
TURN_TTL_SECONDS = 86_400.0
DONE_TTL_SECONDS = 3_600.0
# How much later than others an event may arrive and still be put into its place.
PROBATION_DELAY = "1 hour"
RUN_DELAY = "10 minutes"
TIMEOUT_OUT = "scrape_id bigint, outcome string, note string"


def _in_order(batches: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> pd.DataFrame:
    """The needed columns of a key's rows in a micro-batch, sorted."""
    narrow = [batch[[*order, *columns]] for batch in batches]
    return pd.concat(narrow).sort_values(order, kind="stable")


def _whole(value) -> int:
    return 0 if pd.isna(value) else int(value)


class Reordered(StatefulProcessor):
    """Rows of a key, kept in list state until the watermark has passed them, then applied in order.

    Columns of the stream: `at_us` (event time in microseconds) and `tie` come first, then `fields`.
    A key has one timer at a time, for the earliest row that it keeps or the `deadline` of its state.
    """

    fields: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = ", ".join(f"{c} {kind}" for c, kind in self.fields.items())
        self.kept = handle.getListState("kept", f"at_us bigint, tie bigint, {kept}")
        self.armed = handle.getValueState("armed", "at_ms bigint")

    def apply(self, key, rows: list[tuple], until_us: int) -> pd.DataFrame | None:
        """What the rows change, all that happened up to `until_us` included."""
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When the state changes by itself, in microseconds."""
        return None

    def _arm(self, times_us: list[int]) -> None:
        before = self.armed.get()[0] if self.armed.exists() else None
        first = min(times_us, default=None)
        if first is None or (before is not None and before <= first // 1000 + 1):
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(first // 1000 + 1)
        self.armed.update((first // 1000 + 1,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a chunk at a time: the rows of a batch are never held together
        for batch in rows:
            # whole numbers with gaps come as floats
            whole = {c: "Int64" for c, kind in self.fields.items() if kind == "bigint"}
            narrow = batch[["at_us", "tie", *self.fields]].astype(whole).astype(object)
            chunk = list(narrow.where(narrow.notna(), None).itertuples(index=False, name=None))
            if chunk:
                self.kept.appendList(chunk)
                self._arm([int(r[0]) for r in chunk])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        self.armed.clear()
        due, later = [], []
        for row in self.kept.get():
            (due if row[0] <= until else later).append(tuple(row))
        if due:
            self.kept.clear()
            if later:
                self.kept.put(later)
        out = self.apply(key, sorted(due, key=lambda r: r[:2]), until)
        if out is not None and len(out):
            yield out
        end = self.deadline()
        self._arm([r[0] for r in later] + ([] if end is None else [end]))

    def close(self) -> None:
        pass


class Probation(Reordered):
    """Selector probation per host; a row goes out for every change of state."""

    fields = {"selector": "string", "demote": "boolean"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("probation", "graduated string, candidate string, matches int")

    def apply(self, key, rows, until_us):
        graduated, candidate, matches = self.state.get() if self.state.exists() else (None, None, None)
        changes = []
        for _, event_id, selector, demote in rows:
            before = (graduated, candidate, matches)
            if demote:
                if graduated:
                    graduated, candidate, matches = None, graduated, 0
            elif selector and not graduated:
                matches = matches + 1 if candidate == selector else 1
                candidate = selector
                if matches >= PROBATION:
                    graduated, candidate, matches = candidate, None, None
            if (graduated, candidate, matches) != before:
                changes.append((key[0], event_id, graduated, candidate, matches))
        self.state.update((graduated, candidate, matches))
        return pd.DataFrame(changes, columns=["host", "event_id", "graduated", "candidate", "matches"]
                            ).astype({"event_id": "int64", "matches": "Int32"})


def probation_stream(observations: DataFrame, delay: str = PROBATION_DELAY) -> DataFrame:
    """Changes of the probation state per host. Observations count in the order of `ts` and
    `event_id`, also those that arrive up to `delay` after later ones."""
    rows = observations.where(F.col("demote") | F.col("selector").isNotNull()).select(
        "host", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie"), "selector", "demote")
    return rows.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at")).groupBy(
        "host").transformWithStateInPandas(Probation(), PROBATION_OUT, "append", "EventTime")


class ChatTurn(StatefulProcessor):
    """Text, tool names and reloads of a chat turn.

    A reload goes out once per resource, when a result of a changing tool arrives. The end
    of the turn sends the text and the usage totals of its passes and forgets the turn; a turn
    that gets no more rows is forgotten after the time to live.
    """

    def __init__(self, ttl_s: float):
        self.ttl_ms = int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{c} bigint" for c in USAGE)
        self.text = handle.getValueState("text", f"text string, {fields}", self.ttl_ms)
        self.tools = handle.getMapState("tools", "call_id string", "tool string", self.ttl_ms)
        self.reloaded = handle.getMapState("reloaded", "resource string", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, *used = self.text.get() if self.text.exists() else ("", 0, 0, 0, 0)
        pieces, out, ended = [text], [], False
        for row in _in_order(rows, ["seq"], ["type", "delta", "call_id", "tool", *USAGE]).itertuples():
            if row.type == "TEXT_MESSAGE_CONTENT":
                pieces.append(row.delta or "")
            elif row.type == "TOOL_CALL_START" and row.call_id and row.tool:
                self.tools.updateValue((row.call_id,), (row.tool,))
            elif row.type == "TOOL_CALL_RESULT" and row.call_id and self.tools.containsKey((row.call_id,)):
                resource = TOOL_RELOADS.get(self.tools.getValue((row.call_id,))[0])
                if resource and not self.reloaded.containsKey((resource,)):
                    self.reloaded.updateValue((resource,), (True,))
                    out.append((*key, "reload", resource, None, None, None, None))
            elif row.type == "USAGE":
                used = [a + _whole(getattr(row, c)) for a, c in zip(used, USAGE)]
            elif row.type == "RUN_FINISHED":
                ended = True
        if ended:
            out.append((*key, "turn", "".join(pieces), *used))
            self.text.clear()
            self.tools.clear()
            self.reloaded.clear()
        else:
            self.text.update(("".join(pieces), *used))
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "kind", "value", *USAGE]
                               ).astype({c: "Int64" for c in USAGE})

    def close(self) -> None:
        pass


def chat_stream(events: DataFrame, ttl_s: float = TURN_TTL_SECONDS) -> DataFrame:
    """Reloads and finished turns of a chat event stream (`conv_id`, `turn`, `seq`, `type`,
    `delta`, `call_id`, `tool`, and the usage of a pass: `request_tokens`, `response_tokens`,
    `total_tokens`, `requests`)."""
    return events.groupBy("conv_id", "turn").transformWithStateInPandas(
        ChatTurn(ttl_s), CHAT_OUT, "append", "processingTime")


class RunLimit(StatefulProcessor):
    """A run that does not finish in time fails; a finished one must get its post in time.

    The post id may come with any row of the run, so it is kept. The end of a run clears its
    state; a mark that lives for a while keeps late rows from opening the run again.
    """

    def __init__(self, cap_s: float, link_s: float, done_ttl_s: float):
        self.cap_ms, self.link_ms = int(cap_s * 1000), int(link_s * 1000)
        self.done_ttl_ms = int(done_ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "phase string, linked boolean")
        self.done = handle.getValueState("done", "outcome string", self.done_ttl_ms)

    def _disarm(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _finish(self, key, outcome: str, note: str) -> pd.DataFrame:
        self._disarm()
        self.state.clear()
        self.done.update((outcome,))
        return pd.DataFrame([(key[0], outcome, note)], columns=["scrape_id", "outcome", "note"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        phase, linked = self.state.get() if self.state.exists() else (None, False)
        # of the rows only the last status and whether any has a post matter
        last = None
        for batch in rows:
            linked = linked or bool(batch["job_post_id"].notna().any())
            newest = batch.loc[batch["seq"].idxmax()]
            if last is None or newest["seq"] > last["seq"]:
                last = newest
        now = timerValues.getCurrentProcessingTimeInMs()
        completed = last["status"] == "completed" or phase == "linking"
        if last["status"] == "failed":
            yield self._finish(key, "failed", "run failed")
        elif completed and linked:
            yield self._finish(key, "linked", "completed")
        else:
            entered = "linking" if completed else "running"
            self.state.update((entered, linked))
            if phase != entered:
                self._disarm()
                self.handle.registerTimer(now + (self.link_ms if completed else self.cap_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase = self.state.get()[0] if self.state.exists() else None
        if phase == "running":
            yield self._finish(key, "timed_out", f"graph run exceeded {self.cap_ms // 1000}s cap")
        elif phase == "linking":
            yield self._finish(key, "unlinked", "completed without a post")

    def close(self) -> None:
        pass


class RunLimitByEvents(Reordered):
    """The limits of `RunLimit` on event time: they are measured between the times that the rows carry,
    so a log that is replayed, at any speed and in any batches, gives the outcomes that it gave."""

    fields = {"status": "string", "job_post_id": "bigint"}

    def __init__(self, cap_s: float, link_s: float):
        self.cap_us, self.link_us = int(cap_s * 1e6), int(link_s * 1e6)
        self.cap_s = int(cap_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("run", "phase string, linked boolean, until bigint")

    def deadline(self):
        state = self.state.get() if self.state.exists() else None
        return None if state is None or state[0] == "done" else state[2]

    def apply(self, key, rows, until_us):
        phase, linked, until = self.state.get() if self.state.exists() else (None, False, None)
        ended = None

        def expired(now):
            if phase in ("running", "linking") and until < now:
                return (("timed_out", f"graph run exceeded {self.cap_s}s cap") if phase == "running"
                        else ("unlinked", "completed without a post"))
        for at, _, status, post in rows:
            ended = ended or expired(at)
            if phase == "done" or ended:
                break
            linked = linked or post is not None
            completed = status == "completed" or phase == "linking"
            if status == "failed":
                ended = ("failed", "run failed")
            elif completed and linked:
                ended = ("linked", "completed")
            elif phase != (entered := "linking" if completed else "running"):
                phase, until = entered, at + (self.link_us if completed else self.cap_us)
        ended = None if phase == "done" else ended or expired(until_us)
        if ended:
            phase = "done"
        if phase is not None:
            self.state.update((phase, linked, until))
        return pd.DataFrame([(key[0], *ended)], columns=["scrape_id", "outcome", "note"]) if ended else None


class OpenPosts(StatefulProcessor):
    """Which posts of a part have a score, the first captures of those that have none, and the part's
    head: its first captures of all. A batch that changes the head sends it whole."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scored = handle.getMapState("scored", "job_post_id bigint", "scored boolean")
        self.waiting = handle.getMapState("waiting", "job_post_id bigint", "places string")
        self.head = handle.getValueState("head", "places string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = json.loads(self.head.get()[0]) if self.head.exists() else []
        head, refill = [tuple(x) for x in before], False
        for batch in rows:
            done = batch["scored"].astype(bool)
            for post in batch.loc[done, "job_post_id"].unique().tolist():
                self.scored.updateValue((post,), (True,))
                if self.waiting.containsKey((post,)):
                    self.waiting.removeKey((post,))
                    refill = refill or any(x[2] == post for x in head)
                    head = [x for x in head if x[2] != post]
            for post, group in batch.loc[~done].groupby("job_post_id"):
                post = int(post)
                if self.scored.containsKey((post,)):
                    continue
                places = json.loads(self.waiting.getValue((post,))[0]) if self.waiting.containsKey(
                    (post,)) else []
                places += zip(group["age"].tolist(), group["scrape_id"].tolist())
                places = sorted(map(tuple, places))[:self.size]
                self.waiting.updateValue((post,), (json.dumps(places),))
                head = sorted([x for x in head if x[2] != post] + [(*p, post) for p in places])[:self.size]
        if refill:  # only a score for a post of the head asks for the posts behind it
            head = []
            for (post,), (places,) in self.waiting.iterator():
                head = sorted(head + [(*p, post) for p in json.loads(places)])[:self.size]
        if head != [tuple(x) for x in before]:
            self.head.update((json.dumps(head),))
            rows_out = [(key[0], post, age, scrape) for age, scrape, post in head]
            yield pd.DataFrame(rows_out or [(key[0], None, None, None)],
                               columns=["part", "job_post_id", "age", "scrape_id"]).astype(
                {c: "Int64" for c in ("job_post_id", "age", "scrape_id")} | {"part": "int32"})

    def close(self) -> None:
        pass


def score_queue(events: DataFrame, limit: int, parts: int) -> DataFrame:
    """The heads of the parts that a batch of captures and scores (`job_post_id`, `age`, `scrape_id`,
    `scored`) changes: `part` and captures, or one row without a post if nothing waits there."""
    part = F.pmod(F.xxhash64("job_post_id"), F.lit(parts)).cast("int")
    return events.withColumn("part", part).groupBy("part").transformWithStateInPandas(
        OpenPosts(2 * limit), "part int, job_post_id bigint, age bigint, scrape_id bigint", "append", "none")


def run_timeouts(statuses: DataFrame, cap_s: float = RUN_CAP_SECONDS,
                 link_s: float = LINK_SECONDS, done_ttl_s: float = DONE_TTL_SECONDS,
                 at: str | None = None, delay: str = RUN_DELAY) -> DataFrame:
    """Terminal outcome per run from its status stream (`scrape_id`, `seq`, `status`,
    `job_post_id`), on processing time; or on the event time in the column `at`, for rows that
    arrive up to `delay` after later ones."""
    if at is not None:
        rows = statuses.select("scrape_id", F.col(at).cast("timestamp").alias("at"), F.col("seq").alias("tie"),
                               "status", "job_post_id")
        return rows.withWatermark("at", delay).withColumn("at_us", F.unix_micros("at")).groupBy(
            "scrape_id").transformWithStateInPandas(
            RunLimitByEvents(cap_s, link_s), TIMEOUT_OUT, "append", "EventTime")
    return statuses.groupBy("scrape_id").transformWithStateInPandas(
        RunLimit(cap_s, link_s, done_ttl_s), TIMEOUT_OUT, "append", "processingTime")
