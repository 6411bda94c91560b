"""Personal data: base patterns, and bootstrapped contextual extraction.

The base patterns (e-mail, IP address, card, phone) give the seed entities.
Their surroundings induce lexical patterns: the two words on the left, and the
word on either side.  What looks like a seed's kind in a looser form but is no
seed is an unseen candidate: tokens that hold digits, numbers written in
groups, and addresses without a dot or with a spelled-out at.  Patterns and instances (the distinct values) form a graph that is
scored in rounds: a pattern's confidence for a kind is the score of its
instances over their number, an instance's score the best confidence among its
patterns.  Patterns with enough seeds and confidence discover their
candidates, which take part in the next round as instances.

Built-in functions only.  Texts are scanned once into a slim table of mentions
in the shared folder; the rounds run on distinct (pattern, instance) hashes
with partial aggregates, so a frequent word is only a frequent key of an
equi-join that Spark can split.

Regular expressions are anchored at the start of a run and possessive, and
mentions meet by sorted merges, so a very long text with many of them takes
time in proportion to its length.  48 code points of context are kept on either
side of a mention; a word that they cut makes no pattern.

Defined cases: a null text counts as empty; an empty table gives no rows;
repeated rows are separate documents (their mentions are one instance);
overlapping kinds are all reported; a mention without the needed words around
it induces no pattern; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymind.llm.common import materialize, project
from quaymind.llm.spans import find_all, joined, sha256, when_contains, without_overlaps, without_starts

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns.  A run of the leading class is tried from its start only (or from where the last
# match ended), which gives the same matches without trying every suffix of a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token that holds a digit, from the token's start.
TOKEN = r"(?<![A-Za-z0-9@._%+-])[A-Za-z@._%+-]*+[0-9][A-Za-z0-9@._%+-]*+"
MIN_TOKEN = 6
#: A number in groups, as cards and phones are written, with or without +.
NUMBER = r"(?<![A-Za-z0-9@._%+-])\+?\(?[0-9](?:[\x20().-]{0,3}+[0-9])++"
MIN_DIGITS, MAX_DIGITS = 7, 19
#: An address with any host, and one whose at (and dots) are spelled out in brackets.
ADDRESS = (r"(?<![A-Za-z0-9@._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[{<]\x20?(?:at|AT|@)\x20?[)\]}>]\x20?)[A-Za-z0-9-]++"
           r"(?:(?:\.|\x20?[(\[{<]\x20?(?:dot|DOT|\.)\x20?[)\]}>]\x20?)[A-Za-z0-9-]++)*+")

ROUNDS = 3
#: Distinct seeds that a pattern needs, and its least confidence.
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _small(part: Column) -> Column:
    value = F.ltrim(part, F.lit("0"))
    return F.when(F.length(value) > 3, F.lit(False)).otherwise(F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)


def luhn(digits: Column) -> Column:
    backward = F.split(F.reverse(digits), "")

    def term(d: Column, i: Column) -> Column:
        doubled = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.transform(backward, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _count(digits: Column, low: int, high: int) -> Column:
    return (F.length(digits) >= low) & (F.length(digits) <= high)


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of every kind, as arrays of (s, e, m, left, right)."""
    email = when_contains(text, "@", EMAIL)
    ip = F.filter(find_all(text, IP, context=True), lambda x: F.forall(F.split(x["m"], r"\."), _small))
    card = F.filter(find_all(text, CARD, context=True), lambda x: F.when(
        _count(_digits(x["m"]), 14, 19), luhn(_digits(x["m"]))).otherwise(False))
    phone = F.filter(when_contains(text, "+", PHONE),
                     lambda x: _count(_digits(x["m"]), 10, 15))
    return dict(zip(KINDS, (email, ip, card, phone)))


#: What may stand between a mention and the words around it.
OPENING, CLOSING = r"[\s\"'(\[{<:=]+$", r"^[\s\"')\]}>.,;:!?]+"


def _patterns(x: Column, chars: Column) -> Column:
    """Hashes of the lexical patterns around a mention in a text of so many code points.

    None where a word is missing, or where the kept context cuts it.
    """
    left, right = F.lower(x["left"]), F.lower(x["right"])
    # a word at the text's end is whole; one at the context's end may go on
    left = F.concat(F.when(F.length(x["left"]) == x["s"], F.lit(" ")).otherwise(""), left)
    right = F.concat(right, F.when(x["e"] + F.length(x["right"]) == chars, F.lit(" ")).otherwise(""))
    ahead = F.when(left.rlike(OPENING), F.regexp_replace(left, OPENING, "")).otherwise("")
    behind = F.when(right.rlike(CLOSING), F.regexp_replace(right, CLOSING, "")).otherwise("")
    two = F.regexp_extract(ahead, r"\s(\S+\s+\S+)$", 1)
    one = F.regexp_extract(ahead, r"\s(\S+)$", 1)
    after = F.regexp_extract(behind, r"^(\S+)\s", 1)
    return F.filter(F.array(F.when(two != "", F.xxhash64(F.lit("2"), F.regexp_replace(two, r"\s+", " "))),
                            F.when((one != "") & (after != ""), F.xxhash64(F.lit("lr"), one, after))),
                    lambda h: h.isNotNull())


def mentions(docs: DataFrame) -> DataFrame:
    """One row per document: the base spans and the candidates, with their pattern hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = base_spans(F.col("t"))
    df = docs.select("doc_id", text.alias("t")).withColumn("chars", F.length("t"))
    for k in KINDS:
        df = df.withColumn(k, found[k])
    df = (df.withColumn("token", F.filter(find_all(F.col("t"), TOKEN, context=True), lambda x: F.length(x["m"]) >= MIN_TOKEN))
          .withColumn("number", F.filter(find_all(F.col("t"), NUMBER, context=True), lambda x: _count(
              _digits(x["m"]), MIN_DIGITS, MAX_DIGITS) & x["m"].rlike(r"[\x20().-]")))
          .withColumn("address", F.when(F.col("t").rlike(r"@|[(\[{<]\x20?(?:at|AT)\x20?[)\]}>]"),
                                        find_all(F.col("t"), ADDRESS, context=True)).otherwise(F.filter("token", lambda x: F.lit(False))))
          .drop("t"))
    # one candidate from one place: the number that a token begins, the token that an address begins with
    df = (df.withColumn("address", without_starts(F.col("address"), F.col("token")))
          .withColumn("token", without_starts(F.col("token"), F.col("number"))))
    slim = lambda spans, kind: F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"),
        F.xxhash64(F.lower(x["m"])).alias("instance"), _patterns(x, F.col("chars")).alias("patterns")))
    df = df.withColumn("seeds", F.concat(*[slim(F.col(k), k) for k in KINDS]))
    loose = without_overlaps(F.concat("token", "number", "address"), F.col("seeds"))
    return (df.withColumn("candidates", slim(loose, ""))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "seeds", "candidates",
                    *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]))


def confident_patterns(rows: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
                       min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) after the last round."""
    edge = lambda c: rows.select(F.explode(c).alias("x")).select(
        "x.instance", "x.kind", F.explode("x.patterns").alias("pattern"))
    seeds = edge("seeds").distinct()
    loose = edge("candidates").select("instance", "pattern").distinct()
    # the scores of the first round are the seeds', each 1 for its kind
    edges = materialize(seeds.select("pattern", "instance", "kind", F.lit(1.0).alias("score"))
                        .unionByName(loose.select("pattern", "instance", F.lit(None).cast("string").alias("kind"),
                                                  F.lit(0.0).alias("score"))), "pii-edges")
    best = None
    for turn in range(rounds):
        scored = edges
        if best is not None:
            # an unseen instance takes the kind and confidence of its best pattern
            lent = (edges.where("kind IS NULL").select("pattern", "instance").join(best, "pattern")
                    .groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("b"))
                    .select("instance", F.col("b.kind").alias("lent"), F.col("b.confidence").alias("lent_score")))
            scored = (edges.join(lent, "instance", "left")
                      .select("pattern", "instance", F.coalesce("kind", "lent").alias("kind"),
                              F.when(F.col("kind").isNotNull(), F.col("score"))
                              .otherwise(F.coalesce("lent_score", F.lit(0.0))).alias("score")))
        total = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"s_{k}") for k in KINDS]
        held = [F.count_if(F.col("kind") == k).alias(f"h_{k}") for k in KINDS]
        sums = scored.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *total, *held)
        pick = F.array_max(F.array(*[F.struct((F.col(f"s_{k}") / (F.col("n") + 0.5)).alias("confidence"),
                                              F.col(f"h_{k}").alias("support"), F.lit(k).alias("kind")) for k in KINDS]))
        best = materialize(sums.select("pattern", pick.alias("b")).select("pattern", "b.*")
                           .where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
                           .select("pattern", "kind", "confidence"), "pii-patterns")
    return best


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
                       min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, counts of the base kinds, ``base`` and ``found`` (arrays of s, rank, e, kind).

    A discovered span has the kind ``context_<kind>`` and follows the base kinds.
    """
    rows = materialize(mentions(project(docs, {"doc_id": "bigint", "text": "string"})), "pii-mentions")
    best = confident_patterns(rows, rounds, min_support, min_confidence)
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(len(KINDS) + i))]), F.col("k"))
    hits = (rows.select("row", F.explode("candidates").alias("x"))
            .select("row", "x.s", "x.e", F.explode("x.patterns").alias("pattern"))
            .join(best.select("pattern", F.col("kind").alias("k"), "confidence"), "pattern")
            .groupBy("row", "s", "e").agg(F.max(F.struct("confidence", "k"))["k"].alias("k"))
            .groupBy("row").agg(F.collect_list(F.struct("s", rank.alias("rank"), "e", F.concat(F.lit("context_"), "k").alias("kind")))
                                .alias("more")))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.transform("seeds", lambda x: F.struct(x["s"].alias("s"), F.element_at(order, x["kind"]).alias("rank"),
                                                   x["e"].alias("e"), x["kind"].alias("kind")))
    none = F.filter(F.col("base"), lambda x: F.lit(False))
    return (rows.join(hits, "row", "left").withColumn("base", base)
            .withColumn("found", F.concat("base", F.coalesce("more", none)))
            .select("doc_id", *[f"n_{k}" for k in KINDS], "base", "found"))


def op4_pii(docs: DataFrame) -> DataFrame:
    return find_personal_data(docs).select("doc_id", *[f"n_{k}" for k in KINDS],
                                           sha256(joined(F.col("base"))).alias("base_sha256"),
                                           joined(F.col("found")).alias("spans"))
