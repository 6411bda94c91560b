"""Secret scans: base patterns, and sliding-window entropy over candidate strings.

Spark finds the base spans and the candidate strings (long runs of token
characters) with built-in functions.  Each candidate then goes through a
window per character class whose Shannon entropy follows from incremental
counts: one character enters, one leaves, and only their two terms change.
Windows above the class's threshold are merged into spans; in the class of mixed
cases those that read as paths, identifiers or file names are left out (a key
beside such a name is found, with less than a window of it).  What the allow-list
matches, with the rest of the word it stands in, takes no part in a window; the
text beside it does.  The allow-list never touches base spans.

Defined cases: a null text counts as empty; an empty table gives no rows;
repeated rows are separate documents; equal spans of two kinds are both
reported; a very long text is searched whole (a candidate's windows take linear
time, the places and the redaction of thousands of matches in one text do not); a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymind.llm.common import DOC_COLUMNS, bound_arrow_batches, project
from quaymind.llm.spans import find_all, joined, merged, pieces_between, ranked, sha256
from quaymind.session import ship_package

# The contract's patterns, possessive where nothing can be given back.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]++"
#: A run of 24 or more: shorter runs would be dropped.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Window rule of one class: its characters, window length, least bits, and what a window must hold."""
    kind: str
    characters: str
    window: int
    bits: float
    needs: tuple[str, ...]
    #: Whether windows that read as names are left out: in strings of one case random letters look too much like words.
    names_out: bool = False


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", 20, 2.9, (_DIGITS, "abcdefABCDEF")),
    CharacterClass("entropy_base64", _DIGITS + _UPPER + _LOWER + "+/_-=", 20, 3.6, (_DIGITS, _UPPER, _LOWER), True),
    # one case and digits: with a letter that is no hex digit, else it is the first class
    CharacterClass("entropy_base36", _DIGITS + _LOWER, 20, 3.5, (_DIGITS, _LOWER[6:])),
    CharacterClass("entropy_base32", _DIGITS + _UPPER, 20, 3.4, (_DIGITS, _UPPER[6:])),
)
#: Strings that look random and are no secrets: UUIDs, documented example keys, alphabets, placeholders.
ALLOW = (r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(?i)example|placeholder|your[_-]|x{6,}",
         r"0123456789|(?i:abcdefgh)|(?i:qwertyuiop)", r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")
_UUID = re.compile(ALLOW[0])
_RUN = re.compile(r"[A-Za-z0-9]+")


#: What names are made of: words in one case or capitalised, and short numbers.
_PIECE = re.compile(r"(?P<word>[A-Z]?[a-z]+|[A-Z]+(?![a-z]))|(?P<number>[0-9]+)|(?P<join>[/_+=-])")
_JOINTS = "/_+=-"
_VOWEL, _CLUSTER = re.compile(r"[AEIOUYaeiouy]"), re.compile(r"[^AEIOUYaeiouy]{5}")
#: A window is a name, not a key, when at least this share of its characters stands in words and what joins them.
NAME_SHARE = 0.7


def name_parts(text: str) -> bytearray:
    """1 for every character that reads as part of a name: words of 3 letters or more with a vowel and without long
    consonant clusters; abbreviations and numbers that joints set apart; and what is short between or beside those."""
    out = bytearray(len(text))
    pieces = [(m.start(), m.end(), m.lastgroup) for m in _PIECE.finditer(text)]
    for s, e, kind in pieces:
        apart = (s == 0 or text[s - 1] in _JOINTS) and (e == len(text) or text[e] in _JOINTS)
        if kind == "word" and ((e - s >= 3 and _VOWEL.search(text, s, e) and not _CLUSTER.search(text, s, e))
                               or (apart and e - s <= 4)) or (kind == "number" and apart and e - s <= 8):
            out[s:e] = b"\1" * (e - s)
    for s, e, kind in pieces:
        before, behind = s > 0 and out[s - 1], e < len(text) and out[e]
        if kind == "join":
            out[s] = bool(before or behind)
        elif e - s <= (4 if kind == "number" else 2) and before and (behind or e == len(text) or text[e] in _JOINTS):
            out[s:e] = b"\1" * (e - s)
    return out


def entropy_runs(text: str, rule: CharacterClass) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``rule`` with enough entropy (``names_out``: and that don't read as names)."""
    n, w = len(text), rule.window
    if n < w:
        return []
    named = list(accumulate(name_parts(text), initial=0)) if rule.names_out else [0] * (n + 1)
    most = NAME_SHARE * w
    member, term = set(rule.characters), [0.0] + [c * log2(c) for c in range(1, w + 1)]
    groups = [frozenset(g) for g in rule.needs]
    counts: dict[str, int] = {}
    held, inside, total, out, wide = [0] * len(groups), 0, 0.0, [], []
    limit = w * (log2(w) - rule.bits)      # H >= bits  <=>  sum c*log2(c) <= w*(log2(w) - bits)
    for i, new in enumerate(text):
        if new not in member:              # a foreign character ends the run
            counts, held, inside, total = {}, [0] * len(groups), 0, 0.0
            continue
        c = counts.get(new, 0)
        counts[new], total = c + 1, total + term[c + 1] - term[c] if c < w else total
        inside += 1
        for k, g in enumerate(groups):
            held[k] += new in g
        if inside > w:
            old = text[i - w]
            c = counts[old]
            counts[old], total = c - 1, total + term[c - 1] - term[c] if c <= w else total
            inside -= 1
            for k, g in enumerate(groups):
                held[k] -= old in g
        if inside == w and total <= limit + 1e-9 and all(held):
            _merge(wide, i - w + 1, i + 1)
            if named[i + 1] - named[i + 1 - w] < most:
                _merge(out, i - w + 1, i + 1)
    return _to_word_ends(text, out, wide) if rule.names_out else out


def _merge(runs: list[tuple[int, int]], s: int, e: int) -> None:
    if runs and s <= runs[-1][1]:
        runs[-1] = (runs[-1][0], e)
    else:
        runs.append((s, e))


def _to_word_ends(text: str, runs: list[tuple[int, int]], wide: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs as far as the letters and digits go on, inside the run of windows that had the entropy: a key's end
    that happens to read as a name belongs to the key."""
    out: list[tuple[int, int]] = []
    at = 0
    for s, e in runs:
        while wide[at][1] < e:
            at += 1
        low, high = wide[at]
        while s > low and text[s - 1].isalnum() and text[s].isalnum():
            s -= 1
        while e < high and text[e - 1].isalnum() and text[e].isalnum():
            e += 1
        _merge(out, s, e)
    return out


def without_allowed(text: str, allow: tuple[str, ...] = ALLOW) -> str:
    """``text`` with what the allow-list covers blanked: its matches, and the letters and digits a word is glued to."""
    runs = [m.span() for m in _RUN.finditer(text)]
    starts, spans = [s for s, _ in runs], set()
    for p in allow:
        for m in re.finditer(p, text):
            s, e = m.span()
            if not _UUID.fullmatch(m[0]):
                first, last = (runs[max(bisect_right(starts, at) - 1, 0)] if runs else (0, 0) for at in (s, e - 1))
                s, e = first[0] if first[0] <= s < first[1] else s, last[1] if last[0] < e <= last[1] else e
            spans.add((s, e))
    out, at = [], 0
    for s, e in sorted(spans):
        if e > at:
            out += [text[at:s], "\0" * (e - max(s, at))]
            at = e
    return "".join([*out, text[at:]])


def scan_candidate(text: str, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
    """(start, end, class index) of a candidate's suspicious stretches."""
    if not any(entropy_runs(text, rule) for rule in classes):
        return []
    left = without_allowed(text, allow)
    return [(s, e, k) for k, rule in enumerate(classes) for s, e in entropy_runs(left, rule)]


def _entropy_batches(classes: tuple[CharacterClass, ...], allow: tuple[str, ...]):
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"s": r["s"] + s, "e": r["s"] + e, "k": k}
                      for r in rows or () for s, e, k in scan_candidate(r["m"], classes, allow)]
                     for rows in batch.column("s_candidates").to_pylist()]
            kept = [c for c in batch.schema.names if c != "s_candidates"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(found, kind)],
                                             names=[*kept, "s_entropy"])
    return run


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6
    return {"assign": F.filter(find_all(text, ASSIGN), value),
            "access": F.filter(find_all(text, ACCESS), lambda x: F.length(x["m"]) >= 20),
            "hex": find_all(text, HEX)}


def with_secrets(df: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW,
                 keep_text: bool = True) -> DataFrame:
    """``df`` (with ``text``) and n_assign, n_access, n_hex, ``base`` and ``found`` (arrays of s, rank, e, kind)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = base_spans(text)
    out = df.withColumns({f"s_{k}": found[k] for k in KINDS}).withColumn("s_candidates", find_all(text, CANDIDATE))
    if not keep_text:
        out = out.drop("text")
    ship_package(df.sparkSession)
    bound_arrow_batches(df.sparkSession)
    # the columns pass through as Arrow arrays; Python only looks at the candidates
    entropy = T.StructField("s_entropy", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in "sek"])))
    schema = T.StructType([f for f in out.schema.fields if f.name != "s_candidates"] + [entropy])
    out = out.mapInArrow(_entropy_batches(classes, allow), schema)
    names = F.array(*[F.lit(c.kind) for c in classes])
    more = F.transform("s_entropy", lambda x: F.struct(x["s"].alias("s"), (x["k"] + len(KINDS)).alias("rank"),
                                                       x["e"].alias("e"), F.get(names, x["k"]).alias("kind")))
    return (out.withColumn("base", F.concat(*[ranked(F.col(f"s_{k}"), i, k) for i, k in enumerate(KINDS)]))
            .withColumn("found", F.concat("base", more))
            .withColumns({f"n_{k}": F.size(f"s_{k}").cast("long") for k in KINDS})
            .drop(*[f"s_{k}" for k in KINDS], "s_entropy"))


def find_secrets(docs: DataFrame, **options) -> DataFrame:
    return with_secrets(project(docs, {"doc_id": "bigint", "text": "string"}), keep_text=False, **options)


def op9_secrets(docs: DataFrame) -> DataFrame:
    return find_secrets(docs).select("doc_id", *[f"n_{k}" for k in KINDS], sha256(joined(F.col("base"))).alias("base_sha256"),
                                     joined(F.col("found")).alias("spans"))


PLACEHOLDER = "[SECRET]"


def redacted(text: Column, spans: Column, placeholder: str = PLACEHOLDER) -> Column:
    """The text with every maximal stretch of (overlapping or touching) spans replaced once."""
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces_between(text, merged(spans)), placeholder))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; n_chars follows a changed text."""
    rows = with_secrets(project(docs, DOC_COLUMNS))
    changed = F.size("found") > 0
    return (rows.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(
                redacted(F.col("text"), F.col("found"))))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*DOC_COLUMNS))
