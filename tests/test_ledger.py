"""Reply ledger: one call per distinct prompt, across retried tasks and runs."""

import os
import uuid

import pyarrow as pa
import pytest
from quaymind.operators import ledger as L
from quaymind.operators.infer import EchoProvider, generate_replies


def _calls(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


def _provider(folder):
    """A factory of providers that leave one file per call."""
    class Counting(EchoProvider):  # defined locally so it is shipped by value to the workers
        def generate(self, prompt, model):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(f"{model}|{prompt}")
            return EchoProvider.generate(self, prompt, model)
    return lambda: Counting("main")


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


def test_same_rows_as_plain_calls_and_one_call_a_prompt(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    prompts = ["p" * n for n in range(30)] * 3 + [None] * 50
    df = spark.createDataFrame(list(enumerate(prompts)), "n int, prompt string")
    options = dict(model="main", fallback_model="alt")
    ledger = str(tmp_path / "ledger")
    plain = generate_replies(df, "prompt", lambda: EchoProvider("main"), **options).collect()
    got = L.replies_once(df, "prompt", _provider(str(seen)), ledger, group=4, buckets=3, **options)
    assert got.columns == ["n", "prompt", "reply", "error", "model_used"]
    assert sorted(got.collect(), key=_key) == sorted(plain, key=_key)
    first = _calls(seen)
    assert len(first) == len(set(first))           # the fallback's call is another model's
    # a later run reads every answer and asks only what failed
    again = L.replies_once(df, "prompt", _provider(str(seen)), ledger, default_text="sorry", **options)
    default = generate_replies(df, "prompt", lambda: EchoProvider("main"), default_text="sorry", **options)
    assert sorted(again.collect(), key=_key) == sorted(default.collect(), key=_key)
    failed = {len(p or "") for p in prompts if len(p or "") % 11 == 0}
    assert len({c.partition("|")[2] for c in _calls(seen)}) == 30
    assert len(_calls(seen)) - len(first) == len(failed) + len([n for n in failed if n % 7 == 0])
    # another model has answers of its own
    assert L.read_ledger(spark, ledger, "other").count() == 0


def test_a_retried_task_reads_what_it_asked(tmp_path):
    """The task itself: it breaks off after some groups and runs again over the same rows."""
    seen, ledger = tmp_path / "seen", str(tmp_path / "ledger")
    seen.mkdir()

    class Broken(Exception):
        pass

    rows = [(i % 2, f"h{i}", f"q{i}") for i in range(1, 21)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "prompt_hash", "prompt"])

    def breaking():
        yield batch.slice(0, 12)
        raise Broken

    task = L._asking(_provider(str(seen)), ledger, "run1", "m", None, (503,), 2, 3)
    with pytest.raises(Broken):
        list(task(breaking()))
    before = _calls(seen)
    assert len(before) == 12
    assert [b.column("asked").to_pylist() for b in task(iter([batch]))] == [[8]]
    assert len(_calls(seen)) == len(set(_calls(seen))) == 20
    assert [b.column("asked").to_pylist() for b in task(iter([batch]))] == [[0]]


def test_a_step_done_again_under_its_name_asks_nothing(spark, tmp_path):
    seen, ledger = tmp_path / "seen", str(tmp_path / "ledger")
    seen.mkdir()
    df = spark.createDataFrame([("a" * 11,), ("b",)], "prompt string")      # the first one fails
    for _ in range(2):
        got = L.replies_once(df, "prompt", _provider(str(seen)), ledger, model="m", run="batch-0").collect()
        assert {(r["reply"], r["error"]) for r in got} == {(None, "ProviderError: bad request"), ("[m] b", None)}
    assert len(_calls(seen)) == 2


def test_an_unfinished_file_is_not_read(spark, tmp_path):
    ledger = tmp_path / "ledger"
    L._record(str(ledger), "r", 0, [("h", "m", "yes", None, "m", "r")])
    (ledger / "bucket=00000" / "_half").write_bytes(b"PAR1")
    assert [tuple(r) for r in L.read_ledger(spark, str(ledger), "m").collect()] == [("h", "yes", None, "m")]
    assert L._journal(str(ledger), "m", "r", 0) == {"h"} and L._journal(str(ledger), "m", "other", 0) == set()


def test_empty_table_and_clashing_columns(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([("x", 1)], "prompt string, bucket int")
    got = L.replies_once(df.where("bucket > 1"), "prompt", EchoProvider, ledger, model="m")
    assert got.collect() == []
    assert [tuple(r) for r in L.replies_once(df, "prompt", EchoProvider, ledger, model="m").collect()] == [
        ("x", 1, "[m] x", None, "m")]
