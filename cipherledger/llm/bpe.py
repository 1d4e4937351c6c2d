"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket for each merge rank; a bucket is a heap of linked-list
positions. A two-level bitmap marks the buckets in use, so find-first-set on the
top word and then on the leaf gives the next rank, whatever the length of the
pre-token. A position whose pair has changed since it was queued is stale and
skipped. A pre-token of n bytes costs O(n log n) at most, which matters for
texts without white space.

Defined results: a null text is the empty text and has no ids; ids depend on the
text alone, so repeated rows give repeated results; an empty table gives an empty
table; columns other than doc_id and text are ignored. Any text decodes to its bytes.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF = 8  # a leaf of the bitmap covers 256 ranks
_BIT = [1 << i for i in range(1 << LEAF)]
GENERATION = 1 << 18  # pre-tokens in each of the two generations of the cache
LONG = 64  # longer pre-tokens are not cached


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64(token) rank``."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder of one vocabulary; memory is bounded by the vocabulary and the two cache generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: lowest rank first, leftmost first within a rank."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        want = [-1] * n
        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        top = 0

        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                want[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> LEAF
                    leaves[w] = leaves.get(w, 0) | _BIT[r & 255]
                    top |= 1 << w
        while top:
            w = (top & -top).bit_length() - 1
            leaf = leaves[w]
            r = (w << LEAF) + (leaf & -leaf).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                leaf &= leaf - 1
                leaves[w] = leaf
                if not leaf:
                    top &= top - 1
            if want[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            want[i] = want[j] = -1
            if k < n:
                before[k] = i
                q = get(piece[i : after[k]])
                if q is not None:
                    want[i] = q
                    if q in buckets:
                        heappush(buckets[q], i)
                    else:
                        buckets[q] = [i]
                        w = q >> LEAF
                        leaves[w] = leaves.get(w, 0) | _BIT[q & 255]
                        top |= 1 << w
            p = before[i]
            if p >= 0:
                q = get(piece[p:k], -1)
                want[p] = q
                if q >= 0:
                    if q in buckets:
                        heappush(buckets[q], p)
                    else:
                        buckets[q] = [p]
                        w = q >> LEAF
                        leaves[w] = leaves.get(w, 0) | _BIT[q & 255]
                        top |= 1 << w
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode_into(self, text: str, out: array) -> None:
        """Append the ids of a text."""
        young, old = self.young, self.old
        if len(text) < 1 << 20:
            pieces = self.pattern.findall(text)
        else:
            pieces = (m.group() for m in self.pattern.finditer(text))
        for piece in pieces:
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = self.merge(piece.encode())
                if len(piece) <= LONG:
                    young[piece] = ids
                    if len(young) >= GENERATION:
                        self.old = old = young
                        self.young = young = {}
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text or "", out)
        return out.tolist()

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids; an unknown id raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[bytes, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec a worker, kept between tasks with its cache."""
    if (data, pattern) not in _codecs:
        _codecs.clear()
        _codecs[data, pattern] = Codec(read_ranks(data), pattern)
    return _codecs[data, pattern]


def _load(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # a vocabulary file of fixed size, read once on the driver
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, if asked for, decoded binary: the bytes that the ids stand for."""
    import pyarrow as pa

    data = _load(docs, path)
    doc_id = docs.schema["doc_id"].dataType

    def run(batches):
        codec = _codec(data.value, pattern)
        for batch in batches:
            ids, ends, back = array("i"), [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    codec.encode_into(text, ids)
                if decoded:
                    back.append(codec.decode(ids[ends[-1] :]))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
            columns = [batch.column(0), lists, *([pa.array(back, pa.binary())] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    fields = [T.StructField("doc_id", doc_id), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded binary of the ids of each row; null ids are no ids."""
    import pyarrow as pa

    data = _load(encoded, path)
    doc_id = encoded.schema["doc_id"].dataType

    def run(batches):
        codec = _codec(data.value, pattern)
        for batch in batches:
            back = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "decoded"])

    out = T.StructType([T.StructField("doc_id", doc_id), T.StructField("decoded", T.BinaryType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, out)
