"""Substring joins of two tables of any size through an index of character grams.

Every needle is looked up by one gram only: of its three-character grams (the
needle itself when it is shorter) the one that the fewest texts hold.  The
index keeps (gram, text id) for grams that some needle has, so it holds no
text; candidates meet their text once, by id, and are then checked.  Both
joins are on equality: nothing is broadcast that Spark does not size itself,
and a needle without a rare gram costs what its own candidates cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text; for size 0 the empty run."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def rarest(needles: DataFrame, index: DataFrame, needle: str, part: str) -> DataFrame:
    """``needle`` and, as ``part``, its part with the fewest rows in the index.

    ``needles`` has a row for every part of a needle, ``index`` one for every
    text that holds a part.  Needles with a part that no text holds are
    dropped: they match nothing.
    """
    held = index.groupBy(part).agg(F.count(F.lit(1)).alias("_held"))
    n = F.coalesce(F.col("_held"), F.lit(0))
    return (needles.join(held, part, "left").groupBy(needle).agg(F.min(F.struct(n.alias("n"), F.col(part).alias("part"))).alias("_best"))
            .where(F.col("_best.n") > 0).select(needle, F.col("_best.part").alias(part)))


def substring_pairs(texts: DataFrame, needles: DataFrame, key: str = "tid", text: str = "text",
                    needle: str = "needle") -> DataFrame:
    """``needle, key`` of every text that contains a needle, once each.

    ``key`` is unique in ``texts``; the case is compared as it is; an empty
    needle is contained in every text; null texts and needles match nothing.
    """
    asked = needles.select(needle).where(F.col(needle).isNotNull()).distinct()
    held = texts.select(key, text).where(F.col(text).isNotNull())
    size = F.least(F.length(needle), F.lit(GRAM))
    sizes = sorted(r[0] for r in asked.select(size.alias("size")).distinct().collect())   # at most four rows
    if not sizes:
        return held.select(F.lit("").alias(needle), key).limit(0)
    mine = F.lit(None).cast("array<string>")
    for s in sizes:
        mine = F.when(size == s, grams(F.col(needle), s)).otherwise(mine)
    parts = asked.select(needle, F.explode(mine).alias("_gram"))
    every = F.array_distinct(F.concat(*[grams(F.col(text), s) for s in sizes]))
    index = held.select(key, F.explode(every).alias("_gram")).join(parts.select("_gram").distinct(), "_gram", "left_semi")
    found = rarest(parts, index, needle, "_gram").join(index, "_gram").select(needle, key)
    return found.join(held, key).where(F.contains(F.col(text), F.col(needle))).select(needle, key)
