"""Byte-level BPE encoding and decoding by a segment tree of pair ranks.

A piece of text (one match of the split pattern) starts as its single bytes.
The leaves of a segment tree are its byte positions; a leaf holds the rank of
the pair that starts there, and every inner node the leftmost smallest one of
its children.  The root names the next merge.  A merge changes two leaves at
most on each side (the pair's own and its live left neighbour's; the right
part's leaf is cleared), so each costs a few updates of logarithmic length.

Short pieces go through many trees at once: all distinct pieces of a batch with
the same padded length form one array of trees, and one numpy step does one
merge in each of them.  Long pieces have a tree of their own.  Distinct pieces
are encoded once per worker and remembered in two generations of bounded bytes:
a piece in use moves to the young one, so only what went unused is forgotten.

The vocabulary file is a parameter.  The driver reads it (about 1 MB, a fixed
size) and broadcasts its bytes, so executors need no such file.

Defined cases: a null text counts as empty (no tokens, hash of nothing); an
empty table gives no rows; repeated rows are encoded alike; very long texts are
encoded whole; a null id is kept; extra columns are ignored.  A byte that the
vocabulary lacks raises an error.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quaymind.llm.common import DOC_COLUMNS, bound_arrow_batches, project
from quaymind.session import ship_package

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces of up to this many bytes share arrays of trees.
SHORT = 64
#: Bytes of chunks, and a quarter of them of pieces, in one of a worker's two generations: bounds its memory between texts.
CACHE_BYTES = 64 << 20
#: The same where the ids themselves are returned, beside what earlier stages leave in an executor's memory.
CACHE_BYTES_OF_IDS = 16 << 20
#: Bytes of an entry besides its text and ids, about: two strings and a place in the table.
ENTRY_BYTES = 180
#: Distinct chunks that are encoded at once.
LEARN = 100_000
#: Rows of one array of trees.
TREES = 1 << 13

_NONE = np.iinfo(np.int32).max


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Recent:
    """The ids (comma-joined decimals) of what was used last, in two generations: when the young one is full, the old one goes."""

    def __init__(self, bound: int):
        self.bound, self.held = bound, 0
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def get(self, key: str) -> str | None:
        value = self.young.get(key)
        if value is None:
            value = self.old.pop(key, None)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value: str) -> None:
        self.young[key] = value
        self.held += ENTRY_BYTES + len(key) + len(value)
        if self.held > self.bound:
            self.old, self.young, self.held = self.young, {}, 0


class Codec:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = CACHE_BYTES):
        import regex
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        # every way a token splits into two tokens: (left id, right id) -> the token's rank
        self.base = max(self.tokens) + 1
        keys, made = array("q"), array("i")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    made.append(rank)
        order = np.argsort(np.frombuffer(keys, dtype=np.int64))
        self.pair_keys = np.frombuffer(keys, dtype=np.int64)[order]
        self.pair_ranks = np.frombuffer(made, dtype=np.int32)[order]
        self._pairs: dict[int, int] | None = None
        # decoding table: all tokens' bytes behind one another, and each token's place
        known = sorted(self.tokens)
        lengths = np.zeros(self.base, dtype=np.int64)
        lengths[known] = [len(self.tokens[i]) for i in known]
        self.token_length, self.token_start = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens[i] for i in known), dtype=np.uint8)
        # chunk or piece -> (its ids as int32 bytes, its ids as decimal text)
        self.cache = Recent(cache_bytes)
        self.pieces = Recent(cache_bytes // 4)

    @property
    def pairs(self) -> dict[int, int]:
        """The pairs as a dictionary, made when the first long piece asks for it."""
        if self._pairs is None:
            self._pairs = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        return self._pairs

    # ------------------------------------------------------------ many short pieces

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; a negative id makes no pair."""
        if not len(self.pair_keys):
            return np.full(len(left), _NONE, dtype=np.int32)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], _NONE).astype(np.int32)

    def _encode_short(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Merge in ``len(pieces)`` trees of ``size`` leaves (a power of two) at once."""
        n, width = len(pieces), size + 2
        ids = np.full((n, width), -1, dtype=np.int64)           # id at a live position; column 0 and the last are guards
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        mask = np.arange(size)[None, :] < lengths[:, None]
        ids[:, 1:-1][mask] = self.single[raw]
        if (ids[:, 1:-1][mask] < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))      # live neighbours
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        tree = np.full((n, 2 * size), _NONE, dtype=np.int32)    # node i has the children 2i and 2i + 1
        tree[:, size:] = self._rank(ids[:, 1:-1].ravel(), ids[:, 2:].ravel()).reshape(n, size)
        for start in (1 << b for b in range(size.bit_length() - 2, -1, -1)):
            level = tree[:, 2 * start:4 * start]
            tree[:, start:2 * start] = np.minimum(level[:, 0::2], level[:, 1::2])
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            best = tree[row, 1]
            node = np.ones(len(row), dtype=np.int64)
            for _ in range(size.bit_length() - 1):              # down to the leftmost smallest leaf
                node = 2 * node + (tree[row, 2 * node] != best)
            at = node - size + 1
            gone = after[row, at]
            nxt = after[row, gone]
            ids[row, at], ids[row, gone] = best, -1
            after[row, at], before[row, nxt] = nxt, at
            prev = before[row, at]
            for leaf, rank in ((gone, np.full(len(row), _NONE, dtype=np.int32)),
                               (at, self._rank(ids[row, at], ids[row, nxt])),
                               (prev, self._rank(ids[row, prev], ids[row, at]))):
                ok = leaf >= 1
                r, node = row[ok], leaf[ok] - 1 + size
                tree[r, node] = rank[ok]
                for _ in range(size.bit_length() - 1):
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            row = row[tree[row, 1] < _NONE]
        live = ids[:, 1:-1]
        keep = live >= 0
        flat, ends = live[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [tuple(flat[s:e]) for s, e in zip([0, *ends], ends)]

    # ------------------------------------------------------------ one long piece

    def _encode_long(self, piece: bytes) -> tuple[int, ...]:
        n, pairs, base, none = len(piece), self.pairs, self.base, int(_NONE)
        size = 1 << max(1, (n - 1).bit_length())
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks a single byte")
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = pairs.get(ids[i] * base + ids[i + 1], none)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int) -> None:
            i += size
            tree[i] = rank
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] < none:
            best, i = tree[1], 1
            while i < size:
                i = 2 * i if tree[2 * i] == best else 2 * i + 1
            i -= size
            gone = after[i]
            nxt = after[gone]
            ids[i], ids[gone] = best, -1
            after[i] = nxt
            put(gone, none)
            put(i, pairs.get(best * base + ids[nxt], none) if nxt < n else none)
            if nxt < n:
                before[nxt] = i
            if before[i] >= 0:
                put(before[i], pairs.get(ids[before[i]] * base + best, none))
        return tuple(x for x in ids if x >= 0)

    # ------------------------------------------------------------ texts

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            n = len(piece)
            known = self.ranks.get(piece)
            if known is not None:
                out[i] = (known,)
            elif n <= SHORT:
                groups.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(i)
            else:
                out[i] = self._encode_long(piece)
        for size, members in groups.items():
            for s in range(0, len(members), TREES):
                some = members[s:s + TREES]
                for i, ids in zip(some, self._encode_short([pieces[i] for i in some], size)):
                    out[i] = ids
        return out

    def _split_all(self, chunks: list[str]) -> list[list[str]]:
        """The pattern's matches in every chunk.

        Chunks that start with a space and end with another character go
        through the pattern as one text: no match reaches over such a seam.
        """
        out: list[list[str]] = [[] for _ in chunks]
        plain = [i for i, c in enumerate(chunks) if c[0] == " " and not c[-1].isspace()]
        for i in set(range(len(chunks))).difference(plain):
            out[i] = self.split(chunks[i])
        matches = iter(self.split("".join([chunks[i] for i in plain])))
        for i in plain:
            left, mine = len(chunks[i]), out[i]
            while left:
                m = next(matches)
                mine.append(m)
                left -= len(m)
        return out

    def _learn(self, chunks: list[str]) -> dict[str, str]:
        """Encode chunks (texts that can be split on their own) and remember them."""
        matches = self._split_all(chunks)
        known = {p: self.pieces.get(p) for p in {p for m in matches for p in m}}
        fresh = [p for p, value in known.items() if value is None]
        for piece, ids in zip(fresh, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])):
            known[piece] = ",".join(map(str, ids))
            self.pieces.put(piece, known[piece])
        out = {}
        for chunk, match in zip(chunks, matches):
            if len(match) == 1:
                out[chunk] = known[match[0]]
            else:
                out[chunk] = ",".join([known[p] for p in match])
            self.cache.put(chunk, out[chunk])
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """The ids of every text, as an int32 array and as comma-joined decimals.

        A text is cut before every space that follows a character that is not
        white space: no match of the pattern reaches over such a place, so the
        chunks can be split on their own.
        """
        chunks = [cut(t) if t else [] for t in texts]
        known = {c: self.cache.get(c) for c in {c for parts in chunks for c in parts}}
        fresh = [c for c, value in known.items() if value is None]
        for s in range(0, len(fresh), LEARN):
            known.update(self._learn(fresh[s:s + LEARN]))
        for parts in chunks:
            decimals = ",".join([known[c] for c in parts])
            yield np.fromstring(decimals, dtype=np.int32, sep=","), decimals

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from the decoding table in bounded pieces."""
        ids = np.asarray(ids, dtype=np.int64)
        out = []
        for s in range(0, len(ids), 1 << 18):
            some = ids[s:s + (1 << 18)]
            if len(some) and ((some < 0) | (some >= self.base)).any():
                raise ValueError("an id lies outside the vocabulary")
            n = self.token_length[some]
            if (n == 0).any():
                raise ValueError("an id lies outside the vocabulary")
            ends = np.cumsum(n)
            at = np.repeat(self.token_start[some] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)
            out.append(self.token_bytes[at].tobytes())
        return b"".join(out)


_GAP = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def cut(text: str) -> list[str]:
    if _GAP.search(text):
        return [c for c in _CUT.split(text) if c]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + c for c in rest]


_CODECS: dict[str, Codec] = {}


def _codec(data: bytes, pattern: str, cache_bytes: int = CACHE_BYTES) -> Codec:
    """One codec per worker process, vocabulary and size of its cache."""
    key = f"{hashlib.sha256(data + pattern.encode()).hexdigest()}-{cache_bytes}"
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(data), pattern, cache_bytes)
        gc.freeze()     # its tables live as long as the worker; the collector need not walk them
    return _CODECS[key]


def vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def _split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


#: Characters of text that go through the encoder at once.
BATCH_CHARS = 1 << 20


def _batches(column: pa.Array) -> Iterator[list[str | None]]:
    held, chars = [], 0
    for value in column:
        text = value.as_py()
        held.append(text)
        chars += len(text or "")
        if chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))


def _run(sc, path: str | None, pattern: str | None, cache_bytes: int = CACHE_BYTES_OF_IDS):
    shared = sc.broadcast((vocabulary(path), pattern or _split_pattern(), cache_bytes))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            done = 0
            for texts in _batches(batch.column("text")):
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield part, codec, codec.encode_batch(texts)
    return tokens


def tokenize(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``df`` without text, and ``ids`` (array of int)."""
    ship_package(df.sparkSession)
    bound_arrow_batches(df.sparkSession)
    start = _run(df.sparkSession.sparkContext, path, pattern)
    kept = [f for f in df.schema.fields if f.name != "text"]

    def run(batches):
        for part, _, encoded in start(batches):
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [_lists([i for i, _ in encoded])],
                                             names=[*(f.name for f in kept), "ids"])
    return df.mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def detokenize(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``df`` without ids, and ``text``: the ids' bytes read as UTF-8."""
    ship_package(df.sparkSession)
    bound_arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary(path), pattern or _split_pattern()))
    kept = [f for f in df.schema.fields if f.name != "ids"]

    def run(batches):
        codec = _codec(*shared.value)
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], dtype=np.int64)).decode("utf-8", "replace")
                     for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(texts, pa.string())],
                                             names=[*(f.name for f in kept), "text"])
    return df.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def token_digests(df: DataFrame, path: str | None = None, pattern: str | None = None,
                  cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes they decode to."""
    ship_package(df.sparkSession)
    bound_arrow_batches(df.sparkSession)
    start = _run(df.sparkSession.sparkContext, path, pattern, cache_bytes)

    def run(batches):
        for part, codec, encoded in start(batches):
            n, of_ids, of_bytes = [], [], []
            for ids, decimals in encoded:
                n.append(len(ids))
                of_ids.append(hashlib.sha256(decimals.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_bytes, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = project(df, {"doc_id": "bigint", "text": "string"})
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(docs: DataFrame) -> DataFrame:
    return token_digests(docs)


def encoded_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The documents as token ids: doc_id, lang, source, n_chars, ids and the digests of ``token_digests``."""
    ship_package(docs.sparkSession)
    bound_arrow_batches(docs.sparkSession)
    rows = project(docs, DOC_COLUMNS)
    start = _run(docs.sparkSession.sparkContext, path, pattern)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for part, codec, encoded in start(batches):
            rows = list(encoded)
            ids = [i for i, _ in rows]
            digests = [[hashlib.sha256(x).hexdigest() for x in of] for of in
                       ((d.encode() for _, d in rows), (codec.decode(i) for i in ids))]
            yield pa.RecordBatch.from_arrays(
                [part.column(f.name) for f in kept] + [pa.array([len(i) for i in ids], pa.int64()), _lists(ids)]
                + [pa.array(d, pa.string()) for d in digests],
                names=[*(f.name for f in kept), "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
    return rows.mapInArrow(run, T.StructType([
        *kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
