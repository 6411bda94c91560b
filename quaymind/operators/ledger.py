"""Reply ledger (U1): every distinct prompt is asked once, also across failed tasks and runs.

The ledger is a folder that driver and executors share.  A row is one
prompt's raw answer from one model.  The prompts of a run that the ledger
lacks are dealt by their hash over buckets, one task each; a task writes its
answers in groups as complete files of its bucket while it goes, and a retried
task reads them and asks the rest.  Rows then look their prompt's hash up.

Answers stay for later runs.  Failures hold for the run that met them (its
retried tasks and repeated reads don't ask again); a later run asks anew.

What can be asked twice: a group that was open when its executor was lost
(``group`` prompts a task at most), and the prompts of two copies of one task
that run side by side (speculation) or of two runs at the same time.  Equal
answers then collapse, and of unlike ones all rows take the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymind.operators.infer import RETRYABLE, ask

SCHEMA = "prompt_hash string, model string, reply string, error string, model_used string, run string"
_ARROW = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])
#: Files of one bucket lie in one folder, so that a retried task lists only its own.
_BUCKET = "bucket={:05d}"


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def _journal(ledger: str, model: str, run: str, bucket: int) -> set[str]:
    """Hashes of the prompts that this run has answers for in a bucket."""
    fs, root = _place(ledger)
    at = f"{root}/{_BUCKET.format(bucket)}"
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
             if f.is_file and f.base_name.startswith(run) and f.base_name.endswith(".parquet")]
    done: set[str] = set()
    for name in names:
        with fs.open_input_file(name) as src:
            rows = pq.read_table(src, columns=["prompt_hash", "model"])
        done.update(h for h, m in zip(*(rows.column(c).to_pylist() for c in rows.column_names)) if m == model)
    return done


def _record(ledger: str, run: str, bucket: int, rows: list[tuple]) -> None:
    """One complete file, or none: it gets its name when it is whole."""
    fs, root = _place(ledger)
    at, name = f"{root}/{_BUCKET.format(bucket)}", f"{run}-{uuid.uuid4().hex}"
    fs.create_dir(at, recursive=True)
    # a leading underscore hides it from readers
    with fs.open_output_stream(f"{at}/_{name}") as out:
        pq.write_table(pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=_ARROW), out)
    fs.move(f"{at}/_{name}", f"{at}/{name}.parquet")


def _asking(provider_factory, ledger: str, run: str, model: str, fallback_model, retry_status, concurrency: int, group: int):
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, done, asked = None, {}, 0
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                # a task may hold several buckets
                by_bucket: dict[int, list[tuple[str, str]]] = {}
                for b, h, p in zip(*(batch.column(c).to_pylist() for c in ("bucket", "prompt_hash", "prompt"))):
                    by_bucket.setdefault(b, []).append((h, p))
                for b, prompts in by_bucket.items():
                    if b not in done:
                        done[b] = _journal(ledger, model, run, b)
                    todo = [(h, p) for h, p in prompts if h not in done[b]]
                    for at in range(0, len(todo), group):
                        client = client or provider_factory()
                        part = todo[at:at + group]
                        answers = pool.map(lambda x: ask(client, x[1], model, fallback_model, retry_status), part)
                        _record(ledger, run, b, [(h, model, *a, run) for (h, _), a in zip(part, answers)])
                        asked += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], names=["asked"])
    return run_task


def read_ledger(spark: SparkSession, ledger: str, model: str, run: str | None = None) -> DataFrame:
    """prompt_hash, reply, error and model_used of a model's answers, one row per prompt; failures of ``run`` only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA).select("prompt_hash", "reply", "error", "model_used")
    rows = spark.read.schema(SCHEMA).parquet(ledger).where(
        (F.col("model") == model) & (F.col("error").isNull() | F.col("run").eqNullSafe(F.lit(run))))
    # an answer goes before a failure
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "reply", "error", "model_used")).alias("a")
    return rows.groupBy("prompt_hash").agg(best).select("prompt_hash", "a.reply", "a.error", "a.model_used")


def replies_once(df: DataFrame, prompt: str, provider_factory: Callable[[], object], ledger: str, *,
                 model: str, fallback_model: str | None = None, default_text: str | None = None,
                 retry_status: tuple[int, ...] = RETRYABLE, concurrency: int = 1, group: int = 64,
                 buckets: int = 64, run: str | None = None) -> DataFrame:
    """U1 through a ledger: ``reply``, ``error`` and ``model_used`` for every row, one call per distinct prompt.

    The calls are made at once, not when the result is read; the result only
    looks up.  ``df`` is read twice.  ``group`` prompts are asked between two
    writes to the ledger, ``buckets`` tasks ask.  Runs of the same name share
    their failures, so a step that is done again under its old name (a
    micro-batch) asks nothing twice.  A NULL prompt counts as empty.
    The ledger keeps the raw answers, so ``default_text`` may differ per call.
    """
    from quaymind.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    run = run or uuid.uuid4().hex
    text = F.coalesce(F.col(f"`{prompt}`").cast("string"), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    # equal prompts meet as one row per task before the shuffle
    wanted = df.select(digest.alias("prompt_hash"), text.alias("prompt")).groupBy("prompt_hash").agg(
        F.first("prompt").alias("prompt"))
    missing = wanted.join(read_ledger(spark, ledger, model, run), "prompt_hash", "left_anti").withColumn(
        "bucket", F.pmod(F.xxhash64("prompt_hash"), F.lit(buckets)).cast("int"))
    task = _asking(provider_factory, ledger, run, model, fallback_model, retry_status, concurrency, group)
    missing.repartition(buckets, "bucket").mapInArrow(task, "asked long").write.format("noop").mode("overwrite").save()
    answers = read_ledger(spark, ledger, model, run).withColumnRenamed("prompt_hash", "_prompt_hash")
    out = df.withColumn("_prompt_hash", digest).join(answers.select(
        "_prompt_hash", F.struct("reply", "error", "model_used").alias("_answer")), "_prompt_hash", "left")
    reply, error = F.col("_answer.reply"), F.col("_answer.error")
    if default_text is not None:
        reply, error = F.when(F.coalesce(reply, F.lit("")) == "", F.lit(default_text)).otherwise(reply), F.lit(None).cast("string")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], reply.alias("reply"), error.alias("error"),
                      F.col("_answer.model_used").alias("model_used"))
