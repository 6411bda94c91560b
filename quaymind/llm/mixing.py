"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words.  A document's expected copies are
``target / source_size``; documents are put in one order per source, their
expected copies are prefix-summed, one random offset per source is added, and
a document is emitted once for every integer boundary its interval crosses.

The order within a source is by size first, so neighbouring documents have
nearly the same size and the words taken miss the target by about the size of
the largest document at most.  Ties are ordered by a hash of the id, and a
random last key lets even identical rows be split over tasks.

Ranks come from one range partitioning by (source, size, hash): Spark's range
partitioner splits a hot source over many tasks, each sorts its own range, and
only row counts per (partition, source) are gathered.

Defined cases: null text counts 0 words; the null source is a source of its
own and comes last; a source without words has target 0 and takes nothing; an
empty table gives no rows; repeated rows are separate documents that share the
boundaries crossed between them; equal sizes are ordered by the hash of the
id (null ids first); extra columns are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymind.llm.common import DOC_COLUMNS, global_index, materialize, project, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most this many times its size.
MAX_REPEAT = 3
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, weight and target for a table of (source, source_size).

    Sources above their limit are fixed at it and the rest is shared again by
    weight, until none is above.  Each round is one aggregate over the source
    table; only two sums come back.
    """
    ranked = global_index(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked.withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * max_repeat
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    per_weight, capped = None, -1
    while True:
        above = F.lit(False) if per_weight is None else F.col("weight") * F.lit(per_weight) > limit
        n, fixed, rest = table.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == capped or not rest:
            break
        capped, per_weight = n, float(total - fixed) / float(rest)
    share = F.col("weight") * F.lit(per_weight or 0.0)
    return table.withColumn("target", F.when(share > limit, limit.cast("double")).otherwise(share))


def source_offset(source: Column, seed: int = SEED) -> Column:
    """The source's offset in [0, 1), a multiple of 2**-20: the same in every run."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / F.lit(float(1 << 20))


def document_order(doc_id: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary"))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """``df`` with source_size, target and copies.

    ``df`` needs the columns source, size (words, long) and doc_id; other
    columns are carried.
    """
    carried = df.columns
    ordered = (df.withColumn("mix_order", document_order(F.col("doc_id"), seed))
               .withColumn("mix_salt", F.rand(seed)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["source", "size", "mix_order", "doc_id", "mix_salt"]
    ranged = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # partition number in the upper bits, row number within it in the lower 33
    placed = materialize(ranged.withColumn("mix_at", F.monotonically_increasing_id())
                         .drop("mix_order", "mix_salt"), "mix-order")
    part = F.shiftright("mix_at", 33)
    runs = (placed.groupBy("source", part.alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("mix_at").alias("first"), F.sum("size").alias("words")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-runs")
    sizes = runs.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat).drop("rank", "weight")
    runs = (runs.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
            .select("r.source", "part", "first", "ahead", "source_size", "target"))
    rows = (placed.withColumn("part", part).alias("d")
            .join(runs.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.part") == F.col("r.part"))))
    i = F.col("mix_at") - F.col("first") + F.col("ahead")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = source_offset(F.col("d.source"), seed)
    copies = F.least(F.lit(max_repeat).cast("long"), F.floor((i + 1) * rate + u) - F.floor(i * rate + u))
    return rows.select(*[F.col("d." + c) for c in carried], "source_size", "target", copies.alias("copies"))


def op8_mixing(docs: DataFrame) -> DataFrame:
    rows = project(docs, {"doc_id": "bigint", "text": "string", "source": "string"})
    slim = rows.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix(slim).select("doc_id", "size", "source_size", "target",
                            (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as many times as the mix takes it."""
    rows = project(docs, DOC_COLUMNS)
    mixed = mix(rows.withColumn("size", F.size(words(F.col("text"))).cast("long")))
    return (mixed.where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*DOC_COLUMNS))


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         md5('20' || coalesce(':' || CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS w
  FROM d GROUP BY source),
-- sources in the order in which they reach three times their size as the share per weight rises
r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER before, 0) AS fixed,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest
  FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CAST(total - fixed AS DOUBLE) / rest) AS share FROM r
      WHERE CAST(total - fixed AS DOUBLE) / rest <= 3.0 * source_size / w),
t AS (
  SELECT source, source_size,
         CASE WHEN w * share > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE w * share END AS target,
         CAST('0x' || substr(md5('20:' || coalesce('s' || source, 'n')), 1, 5) AS BIGINT) / 1048576.0 AS u
  FROM r, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.o, d.doc_id NULLS FIRST) - 1 AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, floor((i + 1) * rate + CAST(u AS DOUBLE)) - floor(i * rate + CAST(u AS DOUBLE))) AS BIGINT) AS taken
FROM p
"""
