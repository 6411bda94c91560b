"""Vocabulary parameters.

Vocabularies are DataFrames ``(vocab, term, ordinal)``.  Word-list
vocabularies are small by nature; they are turned into literal arrays
(after a size check) so the classifiers stay single projections with no
join and no shuffle.  Larger dictionaries go through the join paths of the
operators that support them (see ``detect_location``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term list becomes a literal of every task's expression only up to this size; beyond it is an error, never a cut.
LITERAL_BYTES = 8 << 20


def check_literal(rows: DataFrame, column: str, what: str) -> None:
    """Raise when a text column is too large for a literal."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length(column) + 16), F.lit(0))).head()[0]
    if size > LITERAL_BYTES:
        raise ValueError(f"{what} takes {size} bytes, more than the {LITERAL_BYTES} of a literal list")


def terms(vocab: DataFrame, name: str | None = None) -> list[str]:
    """Ordered term list of one vocabulary (size-checked before collecting)."""
    v = vocab if name is None else vocab.filter(F.col("vocab") == name)
    check_literal(v, "term", f"vocabulary {name!r}")
    return [r["term"] for r in v.select("term", "ordinal").orderBy("ordinal").collect()]


def lit_array(values: list[str]):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
