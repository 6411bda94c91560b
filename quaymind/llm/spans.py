"""Match positions from built-in functions, and strings of spans.

A pattern's matches and the pieces between them (``regexp_extract_all`` and
``split`` walk a text the same way) give every match's place by summing
lengths, in code points.  Sums, running maxima and merges go over blocks of
an array (:func:`scan`), so a very long text with many matches costs time in
proportion to its matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a match's surroundings that are kept on either side, whether or not other matches lie in them.
CONTEXT = 48
#: So many matches and pieces before or behind are as long as that at least: neither is empty.
NEIGHBOURS = CONTEXT // 2


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements of an array that one fold of ``scan`` copies.
BLOCK = 128


def scan(values: Column, zero: Column, op) -> Column:
    """Inclusive running ``op`` (associative, with the neutral ``zero``) of an array.

    A fold that appends copies what it has at each step, so folds run inside
    blocks of 128, and one more over the blocks' results.
    """
    empty = F.filter(F.array(zero), lambda x: F.lit(False))

    def fold(block: Column) -> Column:
        return F.aggregate(block, F.struct(zero.alias("at"), empty.alias("sums")),
                           lambda a, x: let(op(a["at"], x), lambda y: F.struct(
                               y.alias("at"), F.concat(a["sums"], F.array(y)).alias("sums"))))

    def above(blocks: Column) -> Column:
        return let(fold(F.transform(blocks, lambda b: b["at"]))["sums"], lambda ahead: F.flatten(F.transform(
            blocks, lambda b, i: F.when(i == 0, b["sums"]).otherwise(
                F.transform(b["sums"], lambda x: op(F.get(ahead, i - 1), x))))))

    def cut(array: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int"))
        return F.when(F.size(array) == 0, array).otherwise(
            let(F.transform(starts, lambda b: fold(F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))), above))

    return let(values, cut)


def without_overlaps(spans: Column, taken: Column) -> Column:
    """The spans (s, e, ...) that share no position with a taken one, by their starts."""
    far = F.lit(2147483647)

    def kept(given: Column) -> Column:
        marks = F.sort_array(F.concat(
            F.transform(taken, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("tag"), x["e"].alias("e"), F.lit(0).alias("i"))),
            F.transform(given, lambda x, i: F.struct(x["s"].alias("s"), F.lit(1).alias("tag"), x["e"].alias("e"), i.alias("i")))))

        def free(order: Column) -> Column:
            # how far those before reach, and where the next one starts
            reach = scan(F.transform(order, lambda x: F.when(x["tag"] == 0, x["e"]).otherwise(0)), F.lit(0), F.greatest)
            after = F.reverse(scan(F.reverse(F.transform(order, lambda x: F.when(x["tag"] == 0, x["s"]).otherwise(far))),
                                   far, F.least))
            return let(F.struct(reach.alias("reach"), after.alias("after")), lambda near: F.transform(
                F.filter(order, lambda x, i: (x["tag"] == 1) & (F.get(near["reach"], i) <= x["s"])
                         & (F.get(near["after"], i) >= x["e"])),
                lambda x: F.get(given, x["i"])))
        return let(marks, free)
    return F.when(F.size(taken) == 0, spans).otherwise(let(spans, kept))


def without_starts(spans: Column, taken: Column) -> Column:
    """The spans that start where no taken one starts, by their starts; neither array repeats a start."""
    def kept(given: Column) -> Column:
        marks = F.sort_array(F.concat(
            F.transform(taken, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("tag"), F.lit(0).alias("i"))),
            F.transform(given, lambda x, i: F.struct(x["s"].alias("s"), F.lit(1).alias("tag"), i.alias("i")))))
        return let(marks, lambda order: F.transform(
            F.filter(order, lambda x, i: (x["tag"] == 1) & ((i == 0) | (F.get(order, i - 1)["s"] != x["s"]))),
            lambda x: F.get(given, x["i"])))
    return F.when(F.size(taken) == 0, spans).otherwise(let(spans, kept))


def merged(spans: Column) -> Column:
    """Maximal stretches (s, e) of the overlapping or touching spans, by their starts."""
    def stretches(order: Column) -> Column:
        def join(reach: Column) -> Column:
            heads = F.filter(F.transform(order, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"))),
                             lambda x: (x["i"] == 0) | (x["s"] > F.get(reach, x["i"] - 1)))
            return let(heads, lambda h: F.transform(h, lambda x, k: F.struct(
                x["s"].alias("s"), F.get(reach, F.coalesce(F.get(h, k + 1)["i"], F.size(reach)) - 1).alias("e"))))
        return let(scan(F.transform(order, lambda x: x["e"]), F.lit(0), F.greatest), join)
    return let(F.sort_array(spans), stretches)


#: Code points of one block of a text that is read at many places.
TEXT_BLOCK = 1_024


def pieces_between(text: Column, stretches: Column) -> Column:
    """What is left of a text around its stretches: one piece before each, and the rest.

    A place in a text is found by walking from its start, so the text is cut
    into blocks once and a piece reads only the blocks that it covers.
    """
    def read(blocks: Column) -> Column:
        def piece(low: Column, high: Column) -> Column:
            first = F.floor(low / TEXT_BLOCK).cast("int")
            last = F.floor((high - 1) / TEXT_BLOCK).cast("int")
            covered = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.when(high <= low, F.lit("")).otherwise(F.substring(covered, low - first * TEXT_BLOCK + 1, high - low))

        def cut(order: Column) -> Column:
            ahead = F.transform(order, lambda x, i: piece(F.coalesce(F.get(order, i - 1)["e"], F.lit(0)), x["s"]))
            rest = piece(F.coalesce(F.get(order, F.size(order) - 1)["e"], F.lit(0)), F.length(text))
            return F.concat(ahead, F.array(rest))
        return let(stretches, cut)
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), read)


def no_spans(context: bool = False) -> Column:
    more = ",left:string,right:string" if context else ""
    return F.expr(f"cast(array() as array<struct<s:int,e:int,m:string{more}>>)")


def find_all(text: Column, pattern: str, context: bool = False) -> Column:
    """Leftmost non-overlapping matches: array of (s, e, m[, left, right]), e exclusive."""
    def located(hits: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def build(between: Column) -> Column:
            lengths = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
            ends = scan(lengths, F.lit(0), lambda a, x: a + x)
            starts = F.zip_with(ends, hits, lambda e, h: e - F.length(h))

            end, begin = (lambda x: F.right(x, F.lit(CONTEXT))), (lambda x: F.left(x, F.lit(CONTEXT)))
            # the end of every piece with its match, and the start of every match with the piece behind it
            tails = F.transform(hits, lambda h, i: end(F.concat(end(F.get(between, i)), end(h))))
            heads = F.transform(hits, lambda h, i: begin(F.concat(begin(h), begin(F.get(between, i + 1)))))

            def rows(around: Column) -> Column:
                at = around["starts"]

                def row(s: Column, i: Column) -> Column:
                    hit = F.get(hits, i)
                    parts = [s.alias("s"), (s + F.length(hit)).alias("e"), hit.alias("m")]
                    if context:
                        before, behind = F.get(between, i), F.get(between, i + 1)
                        ahead = F.slice(around["tails"], F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.least(i, F.lit(NEIGHBOURS)))
                        after = F.slice(around["heads"], i + 2, F.lit(NEIGHBOURS))
                        parts += [F.when(F.length(before) >= CONTEXT, end(before))
                                  .otherwise(end(F.concat(F.array_join(ahead, ""), before))).alias("left"),
                                  F.when(F.length(behind) >= CONTEXT, begin(behind))
                                  .otherwise(begin(F.concat(behind, F.array_join(after, "")))).alias("right")]
                    return F.struct(*parts)
                return F.transform(at, row)
            near = [tails.alias("tails"), heads.alias("heads")] if context else []
            return let(F.struct(starts.alias("starts"), *near), rows)
        return let(pieces, build)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda hits: F.when(F.size(hits) == 0, no_spans(context)).otherwise(located(hits)))


def when_contains(text: Column, needle: str, pattern: str) -> Column:
    """The matches, with context, in texts that hold the needle, else none: spares a scan."""
    return F.when(F.contains(text, F.lit(needle)), find_all(text, pattern, context=True)).otherwise(no_spans(context=True))


def ranked(spans: Column, rank: int, kind: str) -> Column:
    """(s, rank, e, kind) of every span, ready to be sorted."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"),
                                                 F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
