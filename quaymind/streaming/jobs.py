"""Structured Streaming jobs.

T1 routes a message stream with the same column functions as the batch job:
``stream_route`` against a table of replies that exists already,
``run_route`` with the model asked inside the stream, each message once.

T2 keeps the carried search state per conversation.  ``stream_carry_query``
needs the turns of a conversation in order across micro-batches (within a
batch they are sorted) and keeps two small values in
``applyInPandasWithState``.  ``stream_carry_ordered`` takes turns in any
order: a buffer per conversation (``transformWithStateInPandas``) holds early
turns back, and a timer on the watermark gives up on turns that never come.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quaymind.operators import classify as C
from quaymind.operators import match as M
from quaymind.operators.ledger import replies_once


def stream_route(messages: DataFrame, replies: DataFrame, kb: DataFrame, vocab: dict[str, list[str]],
                 ranked_terms: list[str], keys: list[str] | None = None) -> DataFrame:
    """P11 routing plus P6 escalation for each streamed message."""
    routed = M.route_messages(messages, replies, kb, vocab, ranked_terms, keys=keys)
    esc = C.detect_escalation("text", vocab["greeting"], vocab["ticket_logged"], vocab["human"], vocab["ticket"])
    return routed.withColumn("escalate", esc["escalate"]).withColumn("escalation_response", esc["response"])


def once_per_id(messages: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first arrival of each message id.  With an event time, ids are forgotten ``delay`` behind the newest
    message (a repeat must come sooner); without one they are remembered for good."""
    if event_time is None:
        return messages.dropDuplicates(keys)
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_route(messages: DataFrame, prompt: Callable[[DataFrame], DataFrame], provider: Callable[[], object], kb: DataFrame,
              vocab: dict[str, list[str]], ranked_terms: list[str], *, sink: str, checkpoint: str, ledger: str, model: str,
              fallback_model: str | None = None, keys: tuple[str, ...] = ("conv_id", "turn"), event_time: str | None = None,
              delay: str = "1 day", concurrency: int = 1, buckets: int = 64) -> None:
    """T1 with the model inside the stream: labels every available message and writes it to ``sink`` (Parquet).

    ``prompt`` adds a column ``prompt`` to the messages of a micro-batch.
    Only messages that no location or FAQ rule takes are asked.  Answers go through the ledger: a micro-batch that
    is done again after a failure reads them, and overwrites its own folder of the sink (``batch=<id>``), so every
    message id has one label.  A failed call counts as an empty reply.
    """
    keys = list(keys)

    def label(batch: DataFrame, batch_id: int) -> None:
        # the micro-batch is read for its prompts and for its routing
        batch = batch.persist()
        try:
            asked = prompt(batch.where(~M.is_intercepted("text", vocab, ranked_terms))).select(*keys, "prompt")
            replies = replies_once(asked, "prompt", provider, ledger, model=model, fallback_model=fallback_model,
                                   concurrency=concurrency, buckets=buckets, run=f"batch-{batch_id}")
            out = stream_route(batch, replies.select(*keys, F.coalesce("reply", F.lit("")).alias("reply")), kb, vocab,
                               ranked_terms, keys=keys)
            out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        finally:
            batch.unpersist()

    q = (once_per_id(messages, keys, event_time, delay).writeStream.foreachBatch(label)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


CARRY_OUT = ("conv_id long, turn long, effective_query string, preferred_handles array<string>")
CARRY_STATE = "last_eff string, last_handles array<string>"


def _true(flag) -> bool:
    return flag is not None and flag == flag and bool(flag)


def _next_query(carried: str, turn) -> str:
    """The carried text is kept by a refinement without a model and by a blank
    turn, and replaced otherwise; the turn's own text is appended to it."""
    model, asked = (turn.recommended_model or "").strip(), (turn.search_query or "").strip()
    keeps = not (model or asked) or (_true(turn.is_refinement) and not model)
    return " ".join(filter(None, (carried if keeps else "", model, asked)))


def _carry(key, batches: Iterator[pd.DataFrame], state, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    query, shown = state.get if state.exists else (None, None)
    turns = list(pd.concat(list(batches), ignore_index=True).sort_values("turn").itertuples(index=False))
    queries = list(accumulate(turns, _next_query, initial=query or ""))
    # what was shown before each turn: the latest answer with handles
    answers = list(accumulate((t.handles for t in turns), lambda old, new: old if new is None else list(new),
                              initial=list(shown or ())))
    state.update((queries[-1] or None, answers[-1] or None))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame({
        "conv_id": [t.conv_id for t in turns], "turn": [t.turn for t in turns], "effective_query": queries[1:],
        "preferred_handles": [list(h) if _true(t.is_refinement) and h else [] for t, h in zip(turns, answers)]})


def stream_carry_query(turns: DataFrame, idle_timeout_ms: int | None = None) -> DataFrame:
    """W4 + W5 as keyed state per conversation (streaming or batch input).

    Input columns: conv_id, turn, search_query, recommended_model,
    is_refinement, handles (NULL when the turn got no answer).
    ``idle_timeout_ms`` expires the state of idle conversations on a
    continuously running query; leave it None for ``availableNow`` runs
    (a pending processing-time timeout keeps scheduling empty batches).
    """
    from quaymind.session import ship_package
    ship_package(turns.sparkSession)
    if idle_timeout_ms:
        def fn(key, batches, state):
            return _carry(key, batches, state, idle_timeout_ms)
        timeout = GroupStateTimeout.ProcessingTimeTimeout
    else:
        fn, timeout = _carry, GroupStateTimeout.NoTimeout
    return turns.groupBy("conv_id").applyInPandasWithState(fn, CARRY_OUT, CARRY_STATE, "append", timeout)


ORDERED_OUT = CARRY_OUT + ", late boolean"
_HELD = "turn long, search_query string, recommended_model string, is_refinement boolean, handles array<string>"
_Turn = namedtuple("_Turn", [c.split()[0] for c in _HELD.split(", ")])


def _plain(v):
    """A value that state keeps: no pandas or numpy kinds, NaN and NA as None."""
    if v is None or isinstance(v, str):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return None if pd.isna(v) else v


def _preferred(turn, shown: list) -> list:
    return shown if _true(turn.is_refinement) and shown else []


class _Ordered(StatefulProcessor):
    """Holds early turns of a conversation until the turns before them have come or are given up.

    State: ``held``, the waiting turns by number; ``at``, the next turn, the carried text, what was shown last, and
    the ranges of turns given up (flat: from, to, from, to, ...).
    """

    def __init__(self, first_turn: int):
        self.first = first_turn

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "turn long", _HELD.partition(", ")[2] + ", event_ms long")
        self.at = handle.getValueState("at", "next long, query string, shown array<string>, missing array<long>")

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int, str, list, list[int], dict[int, tuple[_Turn, int]]]:
        """The next turn, the carried text, what was shown, the gaps, and the waiting turns with their times."""
        kept = self.at.get()
        if kept is None:
            return self.first, "", [], [], {}
        n, query, shown, missing = kept
        held = {int(k[0]): (_Turn(int(k[0]), *[_plain(x) for x in v][:-1]), int(v[-1])) for k, v in self.held.iterator()}
        return int(n), query or "", list(shown or []), [int(x) for x in missing or []], held

    def _answer(self, conv, state, upto: int, late: list[_Turn], new: set[int]) -> pd.DataFrame:
        """Late turns, then the waiting turns from the next one on: without a gap, or past any gap for turns up to ``upto``.

        Every call to the state store is a message to the JVM: a turn that is answered at once never goes there."""
        at, query, shown, missing, waiting = state
        rows = [(conv, t.turn, _next_query(query, t), _preferred(t, shown), True) for t in late]
        for n in sorted(waiting):
            if n > max(at, upto):
                break
            if n > at:
                missing = [*missing, at, n]
            t, _ = waiting.pop(n)
            if n not in new:
                self.held.removeKey((n,))
            query = _next_query(query, t)
            rows.append((conv, n, query, _preferred(t, shown), False))
            at, shown = n + 1, shown if t.handles is None else t.handles
        for n in sorted(new & waiting.keys()):
            t, event_ms = waiting[n]
            self.held.updateValue((n,), (*t[1:], event_ms))
            self.handle.registerTimer(event_ms)
        self.at.update((at, query or None, shown or None, missing or None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ORDERED_OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._read()
        at, _, _, missing, waiting = state
        late: dict[int, _Turn] = {}
        new: set[int] = set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                t = _Turn(*(_plain(getattr(r, c)) for c in _Turn._fields))
                gap = next((i for i in range(0, len(missing), 2) if missing[i] <= t.turn < missing[i + 1]), None)
                if t.turn >= at and t.turn not in waiting:
                    waiting[t.turn] = (t, int(r.event_ms))
                    new.add(t.turn)
                elif t.turn < at and gap is not None:
                    # it came after all: what is still missing lies around it
                    sides = ((missing[gap], t.turn), (t.turn + 1, missing[gap + 1]))
                    missing[gap:gap + 2] = [x for side in sides if side[0] < side[1] for x in side]
                    late[t.turn] = t
        if new or late:
            yield self._answer(key[0], state, at, [late[n] for n in sorted(late)], new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        state = self._read()
        over = [n for n, (_, event_ms) in state[4].items() if event_ms <= passed]
        if over:
            yield self._answer(key[0], state, max(over), [], set())


def use_keyed_state(spark: SparkSession) -> None:
    """``transformWithState`` needs the state store on RocksDB; running queries keep their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_carry_ordered(turns: DataFrame, event_time: str, delay: str, first_turn: int = 0) -> DataFrame:
    """T2 for turns that arrive in any order: W4 + W5 per conversation, plus ``late``.

    Columns as for :func:`stream_carry_query`, and an event time.  A conversation's turns are numbered without gaps
    from ``first_turn``; a turn is answered as soon as all turns before it were, so without losses the result equals
    the batch result whatever the order.  Turns that are missing are given up once the watermark (``delay`` behind
    the newest event time seen) passes the event time of a turn that waits for them.  A turn that comes after it was given
    up is answered from what is carried by then, marked ``late``, and changes nothing; none is dropped for its age.
    A turn that comes again is passed over, and so is a row without a conversation, turn or event time, or with a
    turn before the first.
    """
    from quaymind.session import ship_package
    ship_package(turns.sparkSession)
    use_keyed_state(turns.sparkSession)
    given = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col(event_time).isNotNull())
    # without the event time itself nothing is filtered as too old: the state decides
    slim = given.withWatermark(event_time, delay).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *_Turn._fields[1:],
        F.unix_millis(F.col(event_time).cast("timestamp")).alias("event_ms"))
    return slim.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_Ordered(first_turn), outputStructType=ORDERED_OUT, outputMode="append", timeMode="eventTime")


def run_available_now(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Drive a streaming DataFrame over all available input into a Parquet
    sink (exactly-once via the checkpoint) and wait for it."""
    q = (df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
