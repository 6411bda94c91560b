"""Batch model calls (U1): prompts in, replies out, in Arrow batches.

The provider is a caller-supplied factory, called once per Python worker
task, returning an object with ``generate(prompt: str, model: str) -> str``.
Failures are data, not exceptions: a retryable status is retried once
with the fallback model; other failures (or a blank reply) give the
default text when one is configured, otherwise an ``error`` value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ProviderError(Exception):
    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


RETRYABLE = (503,)


def ask(client, text: str, model: str, fallback_model: str | None = None,
        retry_status: tuple[int, ...] = RETRYABLE) -> tuple[str | None, str | None, str]:
    """One prompt's (reply, error, model used): one of reply and error is None."""
    used = model
    try:
        try:
            r = client.generate(text, model)
        except ProviderError as e:
            if e.status not in retry_status or not fallback_model:
                raise
            used = fallback_model
            r = client.generate(text, fallback_model)
        return (r or "").strip(), None, used
    except Exception as e:  # failure becomes a value
        return None, f"{type(e).__name__}: {e}", used


def generate_replies(df: DataFrame, prompt: str, provider_factory: Callable[[], object], *,
                     model: str, fallback_model: str | None = None, default_text: str | None = None,
                     retry_status: tuple[int, ...] = RETRYABLE, concurrency: int = 1) -> DataFrame:
    """Add ``reply``, ``error`` and ``model_used`` to every row.

    ``concurrency`` is the number of calls that one task has open at a time.
    Every row is a call, and a retried task calls again; ``replies_once`` of
    :mod:`quaymind.operators.ledger` asks each distinct prompt once.
    """
    from quaymind.session import ship_package
    ship_package(df.sparkSession)

    def call(client, text: str) -> tuple[str | None, str | None, str]:
        reply, error, used = ask(client, text, model, fallback_model, retry_status)
        return (default_text, None, used) if default_text is not None and not reply else (reply, error, used)

    # only the prompts travel to Python; the other columns never leave the JVM
    @F.pandas_udf("reply string, error string, model_used string")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = provider_factory()
        with ThreadPoolExecutor(concurrency) as pool:
            for prompts in batches:
                rows = list(pool.map(lambda p: call(client, "" if p is None else str(p)), prompts))
                yield pd.DataFrame(rows, columns=["reply", "error", "model_used"])

    # a call is not repeated where the plan reads its result more than once
    answer = replies.asNondeterministic()(F.col(f"`{prompt}`"))
    return df.withColumn("u1_answer", answer).select(*[F.col(f"`{c}`") for c in df.columns], "u1_answer.*")


class EchoProvider:
    """Deterministic stand-in provider for tests and fixtures.

    Replies with the model name and the last line of the prompt; fails with
    a retryable status, a hard error, or a blank reply for a fixed share of
    prompts (by prompt length) so every branch of U1 runs.
    """

    def __init__(self, fail_model: str = "primary"):
        self.fail_model = fail_model

    def generate(self, prompt: str, model: str) -> str:
        n = len(prompt)
        if model == self.fail_model and n % 7 == 0:
            raise ProviderError(503, "overloaded")
        if n % 11 == 0:
            raise ProviderError(400, "bad request")
        if n % 13 == 0:
            return "   "
        return self.answer(prompt, model)

    def answer(self, prompt: str, model: str) -> str:
        last = prompt.strip().splitlines()[-1] if prompt.strip() else ""
        return f"[{model}] {last}"


class ScriptedProvider(EchoProvider):
    """The same failures, but the answer is one of the given replies, picked by the prompt's length."""

    def __init__(self, replies: list[str], fail_model: str = "primary"):
        super().__init__(fail_model)
        self.replies = replies

    def answer(self, prompt: str, model: str) -> str:
        return self.replies[len(prompt) % len(self.replies)]


class OptionProvider(EchoProvider):
    """The same failures, but the answer is one of the options that the prompt
    lists (lines that start with "- "), or NO_MATCH, picked by the prompt's length."""

    def answer(self, prompt: str, model: str) -> str:
        listed = prompt.partition("Options:")[2].rpartition("\n\nMessage: ")[0]
        options = [*listed.split("\n- ")[1:], "NO_MATCH"]
        return options[len(prompt) % len(options)]
