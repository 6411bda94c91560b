"""Ranked lexical search by the Best Position Algorithm.

The documents are scored for every query by integer impacts
w * (10**9 * tf div (1000 * tf + 8 * m)), summed over the query's terms; w
falls with the number of documents that hold the term and m grows with the
document's length.

The documents are read once per block of queries: each becomes one row of
(length, numbers and counts of the queries' terms in it).  Spark sums the
document frequencies from these rows.  Then every task takes its rows in
blocks of bounded size, builds the block's impact lists (one per term, highest
impact first) and answers all queries on them:

- sorted accesses go down all lists of the query side by side;
- each document met is at once looked up in the other lists (direct access),
  which also marks its positions there as seen;
- the best position of a list is the end of its unbroken run of seen positions
  from the top, not the last position read; the impacts at the best positions
  add up to the threshold for every document not met yet;
- the search stops when the threshold is strictly below the k-th best score, so
  equal scores are settled by the document's id.

The k-th score of a task's earlier blocks holds in its later ones.  A task
returns at most k rows a query, and a window keeps the k best: no posting
crosses the network, and a very frequent term is spread over all blocks.

Queries are taken in blocks of ``ITEM_BYTES`` of text; only their terms and
the terms' document frequencies pass through the driver.

Defined cases: null and empty texts have no terms and are never found; a query
without terms, or whose terms no document holds, has no rows; every document
row counts and is ranked, also rows with one id; equal scores go to the smaller
id, a null id last; rows of one item_id and text are one query, and queries
with one item_id but other texts share their ranks' numbering; very long texts
are read whole; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymind.llm.common import bound_arrow_batches, materialize, project, read_table
from quaymind.session import ship_package

TOP = 10
#: Bytes of query texts that are answered at once.
ITEM_BYTES = 4 << 20
#: Postings of one block of impact lists (one document's may be more).
BLOCK_POSTINGS = 1 << 20
#: Documents of one block at most.
BLOCK_DOCS = 1 << 15
#: Positions that the first round of sorted accesses takes from every list; it doubles up to the second number.
FIRST_STEP, LAST_STEP = 16, 2048

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: only A-Z is lower-cased, every code point from U+0080 is part of a term."""
    return _TERM.findall(text.lower()) if text else []


def _counted(numbers):
    """doc_id, n and the numbers and counts of the queries' terms of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            n, terms, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                n.append(len(found))
                held = Counter(i for i in map(known.get, found) if i is not None)
                terms.extend(held.keys())
                counts.extend(held.values())
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])
    return run


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The share of one term in a document's score."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        m = np.array([10 + 90 * int(x) * documents // length for x in n], dtype=np.int64)
    else:
        m = 10 + 90 * n * documents // max(length, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class ImpactLists:
    """The lists of one block, by impact for sorted and by document for direct accesses."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int):
        self.docs = docs
        by_doc = np.argsort(term, kind="stable")        # documents ascend in the input
        self.doc, self.impact = doc[by_doc], impact[by_doc]
        terms, starts = np.unique(term[by_doc], return_index=True)
        self.bounds = dict(zip(terms.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)])))
        by_impact = np.lexsort((-self.impact, term[by_doc]))
        self.top_doc, self.top_impact = self.doc[by_impact], self.impact[by_impact]
        place = np.empty(len(term), dtype=np.int64)
        place[by_impact] = np.arange(len(term))
        self.place = place

    def search(self, terms: list[int], k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, and their scores; none scores below ``known``."""
        lists = [self.bounds[t] for t in terms if t in self.bounds]
        best_doc, best_score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if not lists:
            return best_doc, best_score
        met = np.zeros(self.docs, dtype=bool)
        seen = [np.zeros(hi - lo, dtype=bool) for lo, hi in lists]
        best = [0] * len(lists)
        depth, step, longest = 0, FIRST_STEP, max(hi - lo for lo, hi in lists)
        kth = known
        # before any access the tops of the lists bound every document
        threshold = sum(int(self.top_impact[lo]) for lo, _ in lists)
        while depth < longest and threshold >= kth:
            rows = []
            for (lo, hi), marks in zip(lists, seen):
                if depth < hi - lo:
                    rows.append(self.top_doc[lo + depth:min(lo + depth + step, hi)])
                    marks[depth:depth + step] = True
            new = np.unique(np.concatenate(rows))
            new = new[~met[new]]
            met[new] = True
            score = np.zeros(len(new), dtype=np.int64)
            for (lo, hi), marks in zip(lists, seen):
                at = np.searchsorted(self.doc[lo:hi], new)
                at[at == hi - lo] = 0
                hit = self.doc[lo:hi][at] == new
                places = lo + at[hit]
                score[hit] += self.impact[places]
                marks[self.place[places] - lo] = True
            depth, step = depth + step, min(2 * step, LAST_STEP)
            fits = score >= max(kth, 1)
            best_doc = np.concatenate([best_doc, new[fits]])
            best_score = np.concatenate([best_score, score[fits]])
            if len(best_score) >= k:
                kth = max(kth, int(np.partition(best_score, len(best_score) - k)[len(best_score) - k]))
                fits = best_score >= kth
                best_doc, best_score = best_doc[fits], best_score[fits]
            threshold = 0
            for i, ((lo, hi), marks) in enumerate(zip(lists, seen)):
                gap = marks[best[i]:].argmin() if best[i] < len(marks) else 0
                best[i] = len(marks) if best[i] + gap >= len(marks) or marks[best[i]:].all() else best[i] + int(gap)
                # below a list's end there is nothing more to add
                threshold += int(self.top_impact[lo + best[i] - 1]) if best[i] < len(marks) else 0
        return best_doc, best_score


def _answers(shared, k: int, documents: int, length: int):
    """The k best documents of a task's rows, per query."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, postings, rows = [], 0, 0
        for batch in batches:
            size = len(batch.column("terms").flatten())
            if held and (postings + size > BLOCK_POSTINGS or rows + batch.num_rows > BLOCK_DOCS):
                yield pa.Table.from_batches(held)
                held, postings, rows = [], 0, 0
            held.append(batch)
            postings, rows = postings + size, rows + batch.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        # per query: scores, ids, whether the id is null; best first
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in queries]
        for block in blocks(batches):
            lists = block.column("terms").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(block.num_rows), sizes)
            term = lists.flatten().to_numpy()
            tf = block.column("counts").combine_chunks().flatten().to_numpy()
            n = block.column("n").to_numpy()
            index = ImpactLists(doc, term, impacts(tf, n[doc], weights[term], documents, length), block.num_rows)
            no_id = np.asarray(block.column("doc_id").is_null())
            ids = block.column("doc_id").fill_null(0).to_numpy()
            for number, terms in enumerate(queries):
                score, vec, null = kept[number]
                found, scores = index.search(terms, k, int(score[-1]) if len(score) == k else 0)
                if len(found):
                    score = np.concatenate([score, scores])
                    vec, null = np.concatenate([vec, ids[found]]), np.concatenate([null, no_id[found]])
                    order = np.lexsort((vec, null, -score))[:k]
                    kept[number] = (score[order], vec[order], null[order])
        number = np.repeat(np.arange(len(kept)), [len(s) for s, _, _ in kept])
        if len(number):
            score, vec, null = (np.concatenate([x[i] for x in kept]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(vec, mask=null), pa.array(score)],
                                             names=["query", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_arrow_batches(spark)
    texts = project(docs, {"doc_id": "bigint", "text": "string"}).withColumn("text", F.col("text").cast("binary"))
    asked = project(items, {"item_id": "bigint", "text": "string"}).where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // item_bytes))
    out = None
    for s in range(slices):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).collect()
        hits = _search(spark, texts, [r["item_id"] for r in part],
                       [list(dict.fromkeys(terms_of(r["text"].encode()))) for r in part], k)
        out = hits if out is None else out.unionByName(hits)
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(w).cast("int")).select("item_id", "rank", "doc_id", "score")


def _search(spark: SparkSession, texts: DataFrame, ids: list[int | None], queries: list[list[bytes]], k: int) -> DataFrame:
    """The k best documents of a block of queries."""
    sc = spark.sparkContext
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for q in queries for t in q))}
    numbers = sc.broadcast(vocabulary)
    rows = materialize(texts.mapInArrow(_counted(numbers), "doc_id long, n long, terms array<int>, counts array<long>"),
                       "term-counts")
    documents, length = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())
    weights = np.array([term_weight(documents, held.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    shared = sc.broadcast(([[vocabulary[t] for t in q] for q in queries], weights))
    hits = materialize(rows.where(F.size("terms") > 0).mapInArrow(_answers(shared, k, documents, length),
                                                                  "query int, doc_id long, score long"), "hits")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), "number int, item_id long")
    return best.join(names, F.col("query") == F.col("number")).select("item_id", "doc_id", "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SQL_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT rid, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
m AS (SELECT rid, doc_id, 10 + (90 * n * docs) // length AS m FROM n, total),
q AS (SELECT DISTINCT item_id, text, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, text, rid, any_value(doc_id) AS doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, text, rid),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS place
      FROM s WHERE score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
       doc_id, score
FROM r WHERE place <= {TOP}
"""
