"""Stateful operators on a stream of session events, and a run of a stream over the files that are there.

State is a few numbers or rows for each key, and goes when event time has passed it by: each operator sets a timer, and the watermark, ``LATE`` behind
the latest event, fires it. Events behind the watermark are left out, as their state may be gone. Within a micro-batch a key's events are taken by
time and id; an event that arrives in a later batch, but before the watermark, is taken after those of earlier ones. Rows without a session or a time take no part."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import strip_citations
from ..tables import shared_folder

#: Seconds of the units in which limits are given.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
SECOND = 1_000_000
#: How late events may come.
LATE = "10 minutes"


def parse_limit(limit: str) -> tuple[int, int]:
    """("20/minute") -> 20 and 60 seconds; ValueError for anything else."""
    n, _, unit = limit.strip().partition("/")
    unit = unit.strip().lower()
    unit = unit[:-1] if unit.endswith("s") else unit
    if not n.strip().isdigit() or int(n) <= 0 or unit not in UNITS:
        raise ValueError(f"no rate limit: {limit!r}")
    return int(n), UNITS[unit]


def _timed(events: DataFrame) -> DataFrame:
    timed = events.withColumn("when", F.to_timestamp("ts")).withWatermark("when", LATE)
    return timed.select("event_id", "session_id", "action", F.unix_micros("when").alias("at"), "when").where("session_id IS NOT NULL AND at IS NOT NULL")


def _expire(state: GroupState, at: int) -> None:
    """Sets the timer to event time ``at`` (microseconds), or to the next moment if the watermark is past it."""
    state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + 1)


def _by_time(parts: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The columns of a key's events of one micro-batch, whose size the source bounds, by time and id.

    Most keys have a few events, for which frames that are joined, sorted and read by rows cost more than all else."""
    frames = list(parts)
    whole = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in {"at", "event_id", *columns}}
    order = np.lexsort((whole["event_id"], whole["at"]))
    return zip(*(whole[c][order].tolist() for c in columns), strict=True)


def rate_limited(events: DataFrame, limit: str = "20/minute") -> DataFrame:
    """Events over the limit of their session and action, with the seconds until they may be tried again.

    events: a stream of (event_id, session_id, action, ts). A window begins with the first event after the one before ended.
    A session's actions are one state, as a state costs more than the events of most sessions."""
    most, seconds = parse_limit(limit)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # action to (begin of its window, events in it)
        held = {a: (b, n) for a, b, n in zip(*state.get, strict=True)} if state.exists else {}
        over = []
        for event, action, at in _by_time(parts, "event_id", "action", "at"):
            begin, count = held.get(action, (None, 0))
            if begin is None or at >= begin + seconds * SECOND:
                begin, count = at, 0
            held[action] = begin, count + 1
            if count + 1 > most:
                over.append((event, key[0], action, count + 1, max(0, (begin + seconds * SECOND - at + SECOND // 2) // SECOND)))
        # windows that the watermark has passed can't count any more
        past = state.getCurrentWatermarkMs() * 1000 - seconds * SECOND
        held = {a: (b, n) for a, (b, n) in held.items() if b > past}
        state.update((list(held), [b for b, _ in held.values()], [n for _, n in held.values()]))
        _expire(state, max((b for b, _ in held.values()), default=past) + seconds * SECOND)
        if over:
            yield pd.DataFrame(over, columns=["event_id", "session_id", "action", "n", "retry_after"])

    schema = "event_id long, session_id long, action string, n long, retry_after long"
    return _timed(events).groupBy("session_id").applyInPandasWithState(run, schema, "actions array<string>, begins array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def session_uploads(events: DataFrame, most: int = 5, hours: int = 2) -> DataFrame:
    """Each upload: its place among those that its session holds, whether it is taken, and how many more may come.

    What a session holds expires when it isn't used for so many hours; each event counts as use."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = state.get if state.exists else (None, 0)
        out = []
        for event, action, at in _by_time(parts, "event_id", "action", "at"):
            if last is None or at >= last + hours * 3600 * SECOND:
                held = 0
            last = max(int(at), last or int(at))
            if action == "upload":
                taken = held < most
                held += taken
                out.append((int(event), key[0], taken, most - held))
        state.update((last, held))
        _expire(state, last + hours * 3600 * SECOND)
        if out:
            yield pd.DataFrame(out, columns=["event_id", "session_id", "taken", "remaining"])

    schema = "event_id long, session_id long, taken boolean, remaining long"
    return _timed(events).groupBy("session_id").applyInPandasWithState(run, schema, "last long, held long", "append", GroupStateTimeout.EventTimeTimeout)


def recent_turns(exchanges: DataFrame, most: int = 10, hours: int = 2) -> DataFrame:
    """After each micro-batch the last exchanges of every session that it brought: (session_id, turn, place, query, response), place 1 the newest.

    exchanges: a stream of (session_id, turn, query, response, ts). Answers enter without citation markers. A session that hasn't been used for so many hours is forgotten. Exchanges are
    ordered by turn; a turn that comes twice counts once, as it came first. Sessions keep ``most`` exchanges, so state has a bound."""
    timed = exchanges.withColumn("when", F.to_timestamp("ts")).withWatermark("when", LATE)
    rows = timed.select("session_id", "turn", F.coalesce("query", F.lit("")).alias("query"), strip_citations(F.coalesce("response", F.lit(""))).alias("response"), F.unix_micros("when").alias("at"), "when")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, queries, answers, last = state.get if state.exists else ([], [], [], 0)
        new = pd.concat(parts).sort_values(["at", "turn"], ignore_index=True)
        fresh = new["at"].min() < last + hours * 3600 * SECOND
        held = {t: (q, a) for t, q, a in zip(turns, queries, answers, strict=True)} if fresh else {}
        before = None
        for turn, query, response, at in new[["turn", "query", "response", "at"]].itertuples(index=False):
            if before is not None and at >= before + hours * 3600 * SECOND:
                held = {}
            before = at
            held.setdefault(int(turn), (query, response))
            held = dict(sorted(held.items())[-most:])
        last = max(int(new["at"].max()), last)
        state.update((list(held), [q for q, _ in held.values()], [a for _, a in held.values()], last))
        _expire(state, last + hours * 3600 * SECOND)
        newest = sorted(held.items(), reverse=True)
        yield pd.DataFrame([(key[0], t, i, q, a) for i, (t, (q, a)) in enumerate(newest, 1)], columns=["session_id", "turn", "place", "query", "response"])

    rows = rows.where("session_id IS NOT NULL AND turn IS NOT NULL AND at IS NOT NULL")
    schema = "session_id long, turn long, place long, query string, response string"
    kept = "turns array<long>, queries array<string>, answers array<string>, last long"
    return rows.groupBy("session_id").applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def once_each(events: DataFrame, keys: tuple[str, ...], time: str = "ts", late: str = LATE) -> DataFrame:
    """The stream without events that repeat one of the last while: of equal ``keys`` within the watermark's delay the first that came. State goes with the watermark."""
    return events.withColumn(time, F.to_timestamp(time)).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def run_available(spark: SparkSession, path: str, how: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs how(stream) over the Parquet files at path that are there now, and reads what it wrote.

    Progress, state and rows are kept in the shared folder that spark.checkpoint.dir names, so a lost executor's work is done again."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # as a pattern that matches the path only: a plain path must be a folder, and a table may be one file
    files = f"{path[:-1]}[{path[-1]}]"
    out = how(spark.readStream.schema(spark.read.parquet(path).schema).parquet(files))
    run = out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")
