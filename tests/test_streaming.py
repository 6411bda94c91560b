"""T1 with the model inside the stream, and T2 for turns that arrive in any order."""

import os
import random
import uuid

from pyspark.sql import functions as F
from quaymind.operators import documents as D
from quaymind.operators.infer import EchoProvider
from quaymind.streaming import jobs as S

TURN = ("conv_id bigint, turn bigint, search_query string, recommended_model string, is_refinement boolean, "
        "handles array<string>, at timestamp")


def _turns(rnd, convs):
    out = []
    for conv in range(convs):
        for turn in range(rnd.randint(1, 9)):
            out.append((conv, turn, rnd.choice(["", "red", None, " blue "]), rnd.choice(["", None, "galaxy"]),
                        rnd.choice([True, False, None]), None if rnd.random() < 0.3 else [f"h{conv}-{turn}"],
                        1_000_000 + 60 * turn))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, TURN.replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at"))


def _arrive(spark, tmp_path, batches, delay="10 minutes"):
    """One micro-batch per list of turns; the rows that came out, in order of arrival."""
    src, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in batches:
        _frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        S.run_available_now(S.stream_carry_ordered(stream, "at", delay), sink, check)
    return spark.read.parquet(sink).collect()


def test_shuffled_arrival_equals_the_batch_result(spark, tmp_path):
    rnd = random.Random(11)
    rows = _turns(rnd, 25)
    df = _frame(spark, rows)
    query = {(r["conv_id"], r["turn"]): r["effective_query"] for r in D.carry_query(df).collect()}
    shown = {(r["conv_id"], r["turn"]): list(r["preferred_handles"]) for r in D.carry_handles(df).collect()}
    rnd.shuffle(rows)
    cut = len(rows) // 3
    # the second batch repeats some turns of the first
    out = _arrive(spark, tmp_path, [rows[:cut], rows[:5] + rows[cut:2 * cut], rows[2 * cut:]], "1 day")
    assert len(out) == len(rows) and not any(r["late"] for r in out)
    for r in out:
        assert r["effective_query"] == query[r["conv_id"], r["turn"]]
        assert list(r["preferred_handles"]) == shown[r["conv_id"], r["turn"]]


def test_a_lost_turn_is_given_up_and_answered_late(spark, tmp_path):
    t = lambda conv, n, q, at, refine=True: (conv, n, q, "", refine, [f"h{n}"], at)
    hour = 3600
    out = _arrive(spark, tmp_path, [
        [t(1, 0, "phone", hour), t(1, 2, "red", hour + 2)],          # turn 1 is missing
        [t(2, 0, "case", 9 * hour)],                                  # the watermark passes turn 2 of conversation 1
        [t(1, 3, "big", 9 * hour)],
        [t(1, 1, "new", hour + 1), t(1, 1, "new", hour + 1), t(1, 0, "phone", hour), t(1, -1, "x", hour)],
    ])
    got = sorted((r["conv_id"], r["turn"], r["effective_query"], list(r["preferred_handles"]), r["late"]) for r in out)
    assert got == [(1, 0, "phone", [], False), (1, 1, "phone red big new", ["h3"], True), (1, 2, "phone red", ["h0"], False),
                   (1, 3, "phone red big", ["h2"], False), (2, 0, "case", [], False)]


def test_rows_without_keys_and_an_empty_stream(spark, tmp_path):
    out = _arrive(spark, tmp_path, [[(None, 0, "a", "", False, None, 1), (1, None, "a", "", False, None, 1),
                                     (1, 0, "a", "", False, None, None), (3, 0, None, None, None, None, 5)], []])
    assert [(r["conv_id"], r["effective_query"], r["late"]) for r in out] == [(3, "", False)]


def _counting(folder):
    class Counting(EchoProvider):  # defined locally so it is shipped by value to the workers
        def generate(self, prompt, model):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            if prompt.endswith("fail"):
                raise ValueError("no")
            return "Logging_Ticket" if "ticket" in prompt else "delivery"
    return lambda: Counting("none")


def test_the_stream_asks_once_and_labels_every_message(spark, tmp_path):
    from quaymind.sources.fixtures import VOCABULARIES
    src, sink, check, seen = (str(tmp_path / n) for n in ("in", "out", "check", "seen"))
    os.mkdir(seen)
    schema = "conv_id bigint, turn bigint, text string"
    kb = spark.createDataFrame([(0, "delivery", "soon")], "ordinal int, keyword string, answer string")
    batches = [[(1, 0, "my delivery please answer"), (1, 1, "open a ticket for that please"), (2, 0, "my delivery please answer")],
               [(1, 0, "my delivery please answer"), (3, 0, "this will fail"), (4, 0, None), (5, 0, "")]]

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        S.run_route(stream, lambda m: m.withColumn("prompt", F.concat(F.lit("route: "), F.coalesce("text", F.lit("")))),
                    _counting(seen), kb, VOCABULARIES, [], sink=sink, checkpoint=check, ledger=str(tmp_path / "ledger"),
                    model="m", buckets=2)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    got = {(r["conv_id"], r["turn"]): (r["match"], r["answer"]) for r in spark.read.parquet(sink).collect()}
    assert spark.read.parquet(sink).count() == len(got) == 6
    assert got[1, 0] == got[2, 0] == ("delivery", "soon")
    calls = sorted(open(os.path.join(seen, n)).read() for n in os.listdir(seen))
    assert len(calls) == len(set(calls)) and "route: this will fail" in calls
    # the last micro-batch again, as after a failure before its commit: same rows, no call
    last = max(int(n) for n in os.listdir(os.path.join(check, "commits")) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.unlink(os.path.join(check, "commits", name))
    run()
    assert {(r["conv_id"], r["turn"]): (r["match"], r["answer"]) for r in spark.read.parquet(sink).collect()} == got
    assert spark.read.parquet(sink).count() == 6 and len(os.listdir(seen)) == len(calls)


def test_turns_answered_at_once_stay_out_of_the_state():
    """Only a turn that has to wait is written to the state store, with its timer."""
    import pandas as pd
    from quaymind.streaming.jobs import _Ordered
    wrote, timers = [], []

    class State:
        def get(self):
            return None

        def update(self, v):
            self.v = v

    class Held:
        def iterator(self):
            return iter(())

        def updateValue(self, k, v):
            wrote.append(k)

    p = _Ordered(0)
    p.at, p.held = State(), Held()
    p.handle = type("H", (), {"registerTimer": lambda self, t: timers.append(t)})()
    rows = pd.DataFrame({"turn": [1, 0, 3], "search_query": ["b", "a", "d"], "recommended_model": [None] * 3,
                         "is_refinement": [False] * 3, "handles": [None] * 3, "event_ms": [10, 0, 30]})
    out = pd.concat(p.handleInputRows((7,), iter([rows]), None))
    assert list(out["turn"]) == [0, 1] and wrote == [(3,)] and timers == [30] and p.at.v[0] == 2
