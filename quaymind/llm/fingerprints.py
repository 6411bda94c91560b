"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its lower-cased words, each with the number of its
occurrences S.  Sample h of a term draws, from hashes of (h, term) alone,
r and c from Gamma(2, 1) and b from U(0, 1), quantises the weight to
t = floor(ln S / r + b) and scores

    ln a = ln c - r * (t - b + 1).

The term with the smallest score is the sample.  The score is a function of
(term, t), so two texts share a sample exactly when they share the smallest
score, and that happens with the probability of their generalised Jaccard
similarity, sum(min) / sum(max).  A fingerprint lists ``SAMPLES`` samples as
16-bit hashes of their scores; ``likeness`` is the share of equal places.

Built-in column functions only.  A score is distributed as Exp(S), so the
smallest of a text of W words exceeds ``PRUNE`` / W with probability
exp(-PRUNE).  A term whose lower bound (no logarithms: 1 - u3*u4 <= c and
u1*u2 = exp(-r)) lies above that is passed over before the logarithms; a text
left with an open sample is sampled again without the bound, so no result
depends on it.

Terms are exploded, counted and sampled where their text lies: all
aggregations group by the text's key, by which the texts are partitioned
already, and a text is one row, so neither words nor samples are shuffled.

Defined cases: a null text is empty; a text without words has the fingerprint
of zeros and is like another such text (1.0) and unlike any other; equal texts
have equal fingerprints; a very long text is sampled whole, in time linear in
its words; an empty table gives no rows; extra columns are ignored.  In the
query, rows with one doc_id and one text are one document, and each of them is
returned; equal ids are ordered by a digest of the text; a null id comes
first; a single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymind.llm.common import SPACE_CLASS, global_index, materialize, project

#: Samples of a fingerprint.
SAMPLES = 32
#: A sample is left open by the bound with probability exp(-PRUNE); open texts are sampled again without it.
PRUNE = 20.0
#: Hex digits of one sample.
DIGITS = 4
_MASK21, _MASK32 = (1 << 21) - 1, (1 << 32) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+", -1), "")


def _unit(bits: Column, width: int) -> Column:
    """The middle of one of 2**width equal steps of (0, 1)."""
    return (bits.cast("double") + 0.5) / float(1 << width)


def _counted(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """key, w_0.. (words of every text) and, per distinct word, its hash ``term`` and f_0.. (its count in every text)."""
    split = df.select(key, *[_words(F.col(c)).alias(f"words_{i}") for i, c in enumerate(texts)])
    sized = split.select(key, *[F.size(f"words_{i}").alias(f"w_{i}") for i in range(len(texts))],
                         F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"words_{i}").alias("words"))
                                             for i in range(len(texts))])).alias("of"))
    # a text without words keeps one row, whose term is null; numbers of a fixed width make the quicker keys
    rows = sized.select(key, *[f"w_{i}" for i in range(len(texts))], F.col("of.side").alias("side"),
                        F.explode_outer("of.words").alias("word"))
    rows = rows.withColumn("term", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    counts = [F.sum((F.col("side") == i).cast("int") * F.col("term").isNotNull().cast("int")).alias(f"f_{i}")
              for i in range(len(texts))]
    return rows.groupBy(key, *[f"w_{i}" for i in range(len(texts))], "term").agg(*counts)


def _sampled(counted: DataFrame, key: str, sides: int, samples: int, prune: float | None) -> DataFrame:
    """key and ``found``: (h, code of every text) of the samples that are settled in all texts."""
    logs = [F.log(F.col(f"f_{i}").cast("double")).alias(f"l_{i}") for i in range(sides)]
    reach = [F.col(f"f_{i}") * (prune or 0.0) / F.greatest(F.col(f"w_{i}"), F.lit(1)) for i in range(sides)]
    once = [F.col(f"f_{i}") <= 1 for i in range(sides)]
    widest = F.greatest(*reach) if sides > 1 else reach[0]
    alone = once[0]
    for o in once[1:]:
        alone = alone & o
    rows = (counted.select(key, "term", *[f"w_{i}" for i in range(sides)], *logs, widest.alias("reach"),
                           alone.alias("once"))
            .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
            .withColumn("x1", F.xxhash64("h", "term")).withColumn("x2", F.xxhash64("x1")))
    p = (_unit(F.col("x1").bitwiseAND(F.lit(_MASK21)), 21)
         * _unit(F.shiftrightunsigned("x1", 21).bitwiseAND(F.lit(_MASK21)), 21))
    q = _unit(F.shiftrightunsigned("x2", 32), 32) * _unit(F.col("x2").bitwiseAND(F.lit(_MASK32)), 32)
    b = _unit(F.shiftrightunsigned("x1", 42).bitwiseAND(F.lit(_MASK21)), 21)
    rows = rows.withColumn("p", p).withColumn("q", q).withColumn("b", b)
    if prune is not None:
        # S * a >= c * exp(-r) always; with S = 1 it is c * p**(1 - b), and p**y >= p / (y + (1 - y) * p)
        tighter = F.when(F.col("once"), (1.0 - F.col("b")) + F.col("b") * F.col("p")).otherwise(1.0)
        rows = rows.where(F.col("term").isNull() | ((1.0 - F.col("q")) * F.col("p") <= F.col("reach") * tighter))
    rows = rows.withColumn("r", -F.log("p")).withColumn("c", F.log(-F.log("q")))

    def score(i: int) -> Column:
        t = F.floor(F.col(f"l_{i}") / F.col("r") + F.col("b"))
        return F.col("c") - F.col("r") * (t - F.col("b") + 1.0)
    least = rows.groupBy(key, *[f"w_{i}" for i in range(sides)], "h").agg(
        *[F.min(score(i)).alias(f"m_{i}") for i in range(sides)])
    if prune is not None:
        for i in range(sides):
            least = least.where((F.col(f"w_{i}") == 0) | (F.col(f"m_{i}") <= F.log(prune / F.col(f"w_{i}"))))
    codes = [F.coalesce(_code(F.col(f"m_{i}")), F.lit("0" * DIGITS)).alias(f"c_{i}") for i in range(sides)]
    return least.select(key, F.struct("h", *codes).alias("one")).groupBy(key).agg(
        F.sort_array(F.collect_list("one")).alias("found"))


def _code(score: Column) -> Column:
    """A sample as hex digits, never all zeros; null for no sample."""
    value = F.pmod(F.xxhash64(score), F.lit((1 << 4 * DIGITS) - 1)) + 1
    return F.when(score.isNotNull(), F.lower(F.lpad(F.hex(value), DIGITS, "0")))


def fingerprints(df: DataFrame, key: str, texts: list[str], samples: int = SAMPLES, prune: float = PRUNE,
                 beside: DataFrame | None = None) -> DataFrame:
    """``key`` (unique) and, per text column, ``fingerprint_<column>``; written to the shared folder.

    ``beside`` holds more columns per key that come from the same rows; it is
    written in the same job, which then reads the shuffled texts once more
    instead of shuffling them again.
    """
    sides = len(texts)
    pruned = _sampled(_counted(df, key, texts), key, sides, samples, prune)
    extra = [] if beside is None else [c for c in beside.columns if c != key]
    if beside is not None:
        pruned = pruned.unionByName(beside, allowMissingColumns=True)
    written = materialize(pruned, "samples")
    first = written.where(F.col("found").isNotNull()).select(key, "found")
    # a key is open when a sample is missing; one that lost all of them has no row at all
    settled = first.where(F.size("found") == samples)
    keys = written.where(F.col("found").isNull()).select(key) if extra else df.select(key)
    left = materialize(keys.join(settled.select(key), key, "left_anti"), "open-texts")
    if left.limit(1).count():
        again = _sampled(_counted(df.join(left, key, "left_semi"), key, texts), key, sides, samples, None)
        settled = settled.unionByName(materialize(again, "samples-again"))
    out = settled.select(key, *[_joined(f"c_{i}").alias(f"fingerprint_{c}") for i, c in enumerate(texts)])
    if extra:
        out = out.join(written.where(F.col("found").isNull()).select(key, *extra), key)
    return out


def _joined(field: str) -> Column:
    return F.array_join(F.transform("found", lambda x: x[field]), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples: estimates the generalised Jaccard similarity."""
    def at(fingerprint: Column, i: Column) -> Column:
        return F.substring(fingerprint, i * DIGITS + 1, F.lit(DIGITS))
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0),
                        lambda n, i: n + (at(a, i) == at(b, i)).cast("int"))
    return equal / float(samples)


def op11_fingerprints(docs: DataFrame, samples: int = SAMPLES, prune: float = PRUNE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    rows = project(docs, {"doc_id": "bigint", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5("text"), F.length("text"))
    rows = rows.withColumn("rid", F.unhex(F.md5(name)))
    # the order needs ids and lengths only; one row per (doc_id, text)
    slim = rows.groupBy("rid").agg(F.min("doc_id").alias("doc_id"), F.min(F.length("text")).alias("n"),
                                   F.count(F.lit(1)).alias("copies"))
    placed = global_index(slim, [F.col("doc_id").asc_nulls_first(), F.col("rid")], "at")
    total = placed.count()
    if not total:
        return placed.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[
            F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[
            F.lit(0.0).alias(c) for c in ("near_edited", "near_next")])
    ahead = placed.select(F.pmod(F.col("at") - 1, F.lit(total)).alias("at"), F.col("rid").alias("next_rid"))
    linked = materialize(placed.join(ahead, "at").drop("at"), "next-document")

    # a document lends its next-door neighbour as many characters as that one replaces: no more of it is shuffled
    asked = linked.select(F.col("next_rid").alias("rid"), F.col("rid").alias("lent_to"), F.floor(F.col("n") / 4).alias("q"))
    one = rows.groupBy("rid").agg(F.first("text").alias("text"))
    heads = one.join(asked, "rid").select(F.col("lent_to").alias("rid"), "q",
                                          F.expr("substring(text, 1, cast(q as int))").alias("head"))
    edited = one.join(heads, "rid").select("rid", "text", F.concat(
        F.expr("substring(text, 1, length(text) - cast(q as int))"), F.col("head")).alias("edited"))
    digests = edited.select("rid", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    found = materialize(fingerprints(edited, "rid", ["text", "edited"], samples, prune, digests), "fingerprints")

    out = linked.join(found, "rid").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    after = found.select(F.col("rid").alias("next_rid"), F.col("fingerprint_text").alias("next_fingerprint"))
    return out.join(after, "next_rid").select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.col("fingerprint_text").alias("fingerprint"),
        F.col("fingerprint_edited").alias("edited_fingerprint"),
        likeness(F.col("fingerprint_text"), F.col("fingerprint_edited"), samples).alias("near_edited"),
        likeness(F.col("fingerprint_text"), F.col("next_fingerprint"), samples).alias("near_next"))
