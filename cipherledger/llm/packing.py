"""Packing token sequences by linear grouping of their lengths.

1. *Pieces.* Documents become ids and an end id; those longer than CAPACITY are cut.
   Words repeat, so a worker keeps the ids of words between white space (no token and
   no normalisation crosses it) and asks the tokenizer only for new ones.
2. *Counts.* The plan needs the number of pieces of each length: at most CAPACITY rows.
3. *Linear grouping.* Lengths above a third of CAPACITY, in descending order, are divided into GROUPS
   groups of equal cardinality and rounded up to the largest of their group. Few sizes
   are left, so configurations (multisets of sizes that fit a sequence) are optimised
   by column generation: a knapsack finds the configuration that is worth most at the
   current prices of the sizes, a simplex step takes it in. Whole multiples are kept.
4. *Substitution.* The places of a configuration take actual pieces of their group, in
   order of length; what rounding had added is space again.
5. *Best fit.* The remaining large pieces and the small ones, longest first, go where
   the least space is left.

Sequences of equal space and pieces of equal length are handled as runs, so the plan's
size depends on CAPACITY and GROUPS and not on the number of pieces: at most one run a
distinct length, configuration place and fill step. It is made on the driver from the
counts; pieces meet their run by length and by their rank among the pieces of that
length, which is counted in blocks, so that no length is ever in one task.

Defined results: a null text is the empty text and has one piece, the end id; repeated
rows are documents of their own; strings of special tokens are ordinary text; an empty
table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.session import written

CAPACITY = 2048
END = 0  # id after each document
SMALL_SHARE = 3  # lengths up to a third of the capacity only fill
GROUPS = 512
STEPS = 2000  # simplex steps at most; any step leaves a valid packing
BLOCKS = 64  # of pieces of one length that are counted apart
WORDS = 1 << 18  # words in each of the two generations of a worker's cache
LONG = 64  # longer words are not kept
SLICE = 1 << 21  # characters encoded at once
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


# ---------------------------------------------------------------- pieces


class Merges:
    """The merges of a byte-level BPE with word ends, on plain words and many at a time.

    A word is its bytes and one end byte; joining the last byte with it comes before all
    merges. Tokens then follow from the order of their bytes, as ``tiktoken`` merges them,
    and a token that ends in the end byte ends a word.
    """

    # characters that NFC leaves alone, that lower-case one by one, and white space of any tokenizer
    PLAIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u024f]*")
    WORD_END = "\0"

    def __init__(self, tokenizer: dict):
        import regex
        import tiktoken

        model, (split, _) = tokenizer["model"], tokenizer["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        suffix = model["end_of_word_suffix"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte[c] for c in token.removesuffix(suffix)) + self.WORD_END.encode() * end

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        tokens = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(1, 256)] + [raw(a) + raw(b) for a, b in pairs]
        ranks: dict[bytes, int] = {}
        for t in tokens:
            ranks.setdefault(t, len(ranks))
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.ids = np.array([ids.get(t, 0) for t in ranks], "<u4")
        self.ends = np.array([t.endswith(b"\0") for t in ranks])
        self.encoding = tiktoken.Encoding("merges", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def fits(tokenizer: dict) -> bool:
        """Whether words can be lower-cased, divided and merged apart from each other."""
        steps = [n.get("type") for n in (tokenizer["normalizer"] or {}).get("normalizers", [])]
        cuts = (tokenizer["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = tokenizer["model"]
        return (
            steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and not cuts[1]["use_regex"]
            and not cuts[1]["add_prefix_space"] and model["type"] == "BPE" and bool(model["end_of_word_suffix"])
            and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
        )

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words that are PLAIN."""
        parts, last = [], []
        for word in words:
            if word.isalpha():
                parts.append(word)
            else:
                parts += self.pattern.findall(word)
            last.append(len(parts))
        if not parts:
            return [b""] * len(words)
        ranks = np.array(self.encoding.encode_ordinary(self.WORD_END.join(parts) + self.WORD_END))
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ranks]) + 1]) * 4
        raw, bounds = self.ids[ranks].tobytes(), ends[[0, *last]].tolist()
        return [raw[low:high] for low, high in zip(bounds[:-1], bounds[1:])]


class Vocabulary:
    """Ids of texts, as little-endian 32-bit words; the memory for words is bounded by two generations of WORDS."""

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel units
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        plan = json.loads(data)
        self.merges = Merges(plan) if Merges.fits(plan) else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, plain: list[str], rest: list[str]) -> None:
        """Add words to the young generation."""
        for words, encode in ((plain, self.merges and self.merges.encode), (rest, self._tokens)):
            known = [(w, ids) for w in words if (ids := self.old.get(w)) is not None]
            self.young.update(known)
            new = [w for w in words if w not in self.young] if known else words
            self.young.update(zip(new, encode(new), strict=True) if new else ())

    def _tokens(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > WORDS:
            self.old, self.young = self.young, {}
        split, plain, rest = [], set(), set()
        for text in texts:
            if not text:
                words = []
            elif self.merges and Merges.PLAIN.fullmatch(text):
                words = text.lower().split()
                plain.update(words)
            else:
                words = _SPACE.split(text)
                rest.update(words)
            split.append(words)
        plain = [w for w in plain if w not in self.young]
        rest = [w for w in rest.difference(plain) if w not in self.young]
        self._learn(plain, rest)
        out = [b"".join(map(self.young.__getitem__, words)) for words in split]
        for word in (*plain, *rest):
            if len(word) > LONG:
                self.young.pop(word, None)
        return out


def _slices(texts: list[str | None]):
    """(first, last) of stretches of about SLICE characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


_vocabularies: dict[bytes, Vocabulary] = {}


def _vocabulary(data: bytes) -> Vocabulary:
    """One a worker, kept between tasks with its words."""
    if data not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[data] = Vocabulary(data)
    return _vocabularies[data]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document."""
    import pyarrow as pa

    with open(path, "rb") as f:  # a vocabulary file of fixed size, read once on the driver
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        vocabulary = _vocabulary(data.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _slices(texts):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(vocabulary.encode(texts[low:high]), low):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names)

    longs = [T.StructField(n, T.LongType()) for n in names[2:]]
    out = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *longs])
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, out)


# ---------------------------------------------------------------- plan


@dataclass
class Plan:
    """Runs of placements: the pieces of ``length`` with ranks from ``rank`` on, ``n`` of them, ``per`` to a sequence.

    The piece of rank ``rank + i`` goes to sequence ``first + i // per`` at ``offset + (i % per) * length``.
    """

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank, n, first, per, offset
    space: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # space left -> runs (first, n) of sequences
    spaces: list[int] = field(default_factory=list)  # sorted space left of sequences that can still take something

    def leave(self, space: int, first: int, n: int) -> None:
        if space and n:
            if space not in self.space:
                self.space[space] = []

                bisect.insort(self.spaces, space)
            self.space[space].append((first, n))

    def fit(self, length: int, rank: int, n: int) -> None:
        """Best fit of n pieces: fullest sequences first, new ones when none has the space."""

        while n:
            at = bisect.bisect_left(self.spaces, length)
            if at < len(self.spaces):
                space = self.spaces[at]
                first, many = self.space[space].pop()
                if not self.space[space]:
                    del self.space[space], self.spaces[at]
            else:
                per = self.capacity // length
                space, first, many = self.capacity, self.sequences, -(-n // per)
                self.sequences += many
            per = space // length
            full = min(many, n // per)
            if full:
                self.runs.append((length, rank, full * per, first, per, self.capacity - space))
                self.leave(space - per * length, first, full)
                rank, n = rank + full * per, n - full * per
            if full < many and n:  # the last sequence takes fewer
                self.runs.append((length, rank, n, first + full, n, self.capacity - space))
                self.leave(space - n * length, first + full, 1)
                full, n = full + 1, 0
            self.leave(space, first + full, many - full)


def groups(counts: dict[int, int], small: int, many: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(largest length, [(length, n), ...] in descending order) of groups of equal cardinality of the lengths above ``small``."""
    large = [(l, n) for l, n in sorted(counts.items(), reverse=True) if l > small]
    each = max(1, -(-sum(n for _, n in large) // many))
    out, room = [], 0
    for length, n in large:
        while n:
            if not room:
                out.append((length, []))
                room = each
            m = min(n, room)
            out[-1][1].append((length, m))
            n, room = n - m, room - m
    return out


def best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most: a knapsack, one place more each turn."""
    worth = [np.zeros(capacity + 1)]
    for _ in range(capacity // int(sizes.min())):
        last, more = worth[-1], worth[-1].copy()
        for s, p in zip(sizes.tolist(), price.tolist()):
            np.maximum(more[s:], last[: capacity + 1 - s] + p, out=more[s:])
        if (more == last).all():
            break
        worth.append(more)
    out, c = np.zeros(len(sizes), int), capacity
    for turn in range(len(worth) - 1, 0, -1):
        if worth[turn][c] > worth[turn - 1][c]:
            fits = np.flatnonzero(sizes <= c)
            k = fits[(worth[turn - 1][c - sizes[fits]] + price[fits]).argmax()]
            out[k] += 1
            c -= int(sizes[k])
    return float(worth[-1][capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[np.ndarray, int]]:
    """(number of places of each size, whole multiples): the linear optimum by column generation, rounded down."""
    basis = np.diag(capacity // sizes).astype(float)
    amount = demand / np.diag(basis)
    for _ in range(steps):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = best_configuration(sizes, price, capacity)
        if worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, column.astype(float))
        rows = np.flatnonzero(change > 1e-12)
        leaving = rows[(amount[rows] / change[rows]).argmin()]
        step = max(0.0, amount[leaving] / change[leaving])
        amount = amount - step * change
        amount[leaving] = step
        basis[:, leaving] = column
    return [(np.rint(basis[:, j]).astype(int), int(x + 1e-6)) for j, x in enumerate(amount) if x + 1e-6 >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = CAPACITY // SMALL_SHARE, many: int = GROUPS) -> Plan:
    """Runs that place every piece; ``counts``: length -> number of pieces."""
    out = Plan(capacity)
    counts = {l: n for l, n in counts.items() if n}
    ranks = dict.fromkeys(counts, 0)
    if counts.get(capacity):
        out.runs.append((capacity, 0, counts[capacity], 0, 1, 0))
        out.sequences = counts[capacity]
        ranks[capacity] = counts.pop(capacity)
    grouped = groups(counts, small, many)
    if grouped:
        # groups that start at the same length are one size
        sizes = np.array(sorted({top for top, _ in grouped}, reverse=True))
        where = {int(s): k for k, s in enumerate(sizes)}
        members: list[list[list[int]]] = [[] for _ in sizes]
        demand = np.zeros(len(sizes))
        for top, items in grouped:
            members[where[top]] += [[length, n] for length, n in items]
            demand[where[top]] += sum(n for _, n in items)
        queues = [list(reversed(m)) for m in members]
        for places, multiples in configurations(sizes, demand, capacity):
            runs = [(out.sequences, multiples, 0)]  # first, n, filled
            out.sequences += multiples
            for k in np.repeat(np.arange(len(sizes)), places):
                filled = []
                for first, n, used in runs:
                    while n and queues[k]:
                        length, left = queues[k][-1]
                        m = min(n, left)
                        out.runs.append((length, ranks[length], m, first, 1, used))
                        ranks[length] += m
                        filled.append((first, m, used + length))
                        first, n = first + m, n - m
                        queues[k][-1][1] -= m
                        if m == left:
                            queues[k].pop()
                    if n:  # a place that has run out of pieces
                        filled.append((first, n, used))
                runs = filled
            for first, n, used in runs:
                out.leave(capacity - used, first, n)
    for length in sorted(counts, reverse=True):
        out.fit(length, ranks[length], counts[length] - ranks[length])
    return out


# ---------------------------------------------------------------- placement


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (row, length, ...) with ``rank``: the number of the row among those of its length, from 0."""
    block = (F.col("row") % BLOCKS).alias("block")
    keyed = rows.withColumn("block", block)
    sums = keyed.groupBy("length", "block").count()
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("row"))
    numbered = keyed.withColumn("inside", inside)
    return numbered.join(starts, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("block", "inside", "before")


def placed(rows: DataFrame, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """``rows`` (with length and rank) with sequence_id and offset."""
    import pyarrow as pa

    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    shared = rows.sparkSession.sparkContext.broadcast(table)  # bounded by CAPACITY and GROUPS
    names = [c for c in rows.columns if c != "rank"]

    def run(batches):
        length_, rank_, _, first, per, offset = shared.value.T
        bounds = np.searchsorted(length_, np.arange(length_.max(initial=0) + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for l in np.unique(length):
                low, high = bounds[l], bounds[l + 1]
                here = length == l
                at[here] = low + np.searchsorted(rank_[low:high], rank[here], "right") - 1
            i = rank - rank_[at]
            columns = [pa.array(first[at] + i // per[at]), pa.array(offset[at] + i % per[at] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, [*names, "sequence_id", "offset"])

    longs = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in names] + longs))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, small: int | None = None, many: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = written(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = dict(rows.groupBy("length").count().collect())  # at most capacity rows
    small = capacity // SMALL_SHARE if small is None else small
    out = placed(ranked(rows), plan(counts, capacity, small, many).runs)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
