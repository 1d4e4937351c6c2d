"""Quality rules and n-gram perplexity bands.

The model is an interpolated modified Kneser-Ney model of bytes as they stand, of order
LONG. Every n-gram of every text is counted. Tasks work in chunks of texts: the distinct
n-grams of a chunk are sorted arrays, dealt to classes by the hash of the three bytes
before the last one, which all orders above ORDER share; so a class holds whatever their
counts, contexts and continuations need, and the number of classes follows the input.
A class merges the arrays of all chunks into its part of the model, answers each chunk
with the log probabilities of the n-grams that it asked for (steps of 1 / SCALE), and
the chunk adds them up by document. Only the orders up to ORDER, at most ALPHABET^ORDER
rows, and the counts of counts pass the driver and are broadcast.

A text is never scored by itself: texts fall into two folds by their bytes, equal texts
into one, and each fold is scored by the model of the other. A document's score is its
mean negative log probability a byte.

Bands are language-specific: for each value of ``lang`` (null is one value) the
median score, and around it the quartiles of the deviation times the square root of
the length, widened by SPREAD interquartile ranges to both sides: a mean over n
bytes varies by 1 / sqrt(n). SLACK is added to both sides. Documents outside are
rejected, as are those that fail the base rules. Documents
with fewer than MIN_WORDS words say too little for a band and fail the base rules.

Defined results: null text has no words, fails the base rules and has no score;
repeated rows are all scored and all counted; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.llm import words
from cipherledger.session import written

LONG = 6  # byte 0 stands before a document
ORDER = 3  # up to here the model is broadcast
ALPHABET = 256
SCALE = 2048
MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SPREAD = 3.0
SLACK = 0.01
_PIECE = 1 << 20
_CHUNK = 1 << 25  # bytes of text
_CLASS_BYTES = 1 << 24  # of text, for each class
_CLASSES = 32  # at least
_PLACES = ((2, 40), (3, 32), (4, 24), (1, 16), (0, 8), (5, 0))  # byte of an n-gram, bit of its key


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of LONG bytes that end at each byte, and offsets of documents in them.

    The bytes next to the last one come first, so that the contexts of all orders above ORDER are prefixes.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = bytes(LONG - 1)
    raw = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    n = len(raw) - LONG + 1
    key = np.zeros(n, np.uint64)
    for j, place in _PLACES:
        key |= raw[j : j + n].astype(np.uint64) << np.uint64(place)
    shown = np.ones(n, bool)  # windows that end in a document
    ends = np.cumsum(sizes + LONG - 1) - (LONG - 1)
    if len(texts) > 1:
        at = (ends[:-1, None] + np.arange(LONG - 1)).ravel()
        shown[at] = False
    return key[shown], np.concatenate(([0], np.cumsum(sizes)))


def _less(key: np.ndarray) -> np.ndarray:
    """The keys without the first byte of their n-grams."""
    return (key >> np.uint64(16) << np.uint64(8)) | (key & np.uint64(255))


def _low(key: np.ndarray) -> np.ndarray:
    """The codes of the last ORDER bytes of keys that are cut to ORDER + 1 bytes."""
    return (key & np.uint64(0xFFFFFF)).astype(np.int32)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    return (key[first], np.add.reduceat(n, first)) if len(key) else (key, n)


def _fold(text: bytes) -> int:
    return zlib.crc32(text) & 1


def _own(texts: list[bytes], fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts of a fold, sorted, and their counts."""
    keys, n = [], []
    mine = [t for t in texts if _fold(t) == fold]
    for a, b in words.batches(mine, 4 * _PIECE):
        key, count = np.unique(_keys(mine[a:b])[0], return_counts=True)
        keys.append(key)
        n.append(count.astype(np.int64))
    return _summed(keys, n)


def _dealt(key: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by class, and where each class starts in it."""
    kind = (words.mix(key >> np.uint64(24)) % np.uint64(classes)).astype(np.int32)
    order = np.argsort(kind, kind="stable")
    return order, np.searchsorted(kind[order], np.arange(classes + 1))


def _pack(values: np.ndarray, width: int = 8) -> bytes:
    """Integers as compressed planes of their lower ``width`` bytes."""
    import pyarrow as pa

    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpack(packed: bytes, n: int, width: int = 8) -> np.ndarray:
    import pyarrow as pa

    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(packed, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _chunks(batches):
    """Name, rows and texts of each chunk of a task; the name tells the texts, so that another reading can't be taken for it."""
    from pyspark import TaskContext

    seq = 0
    for batch in batches:
        texts = words.utf8(batch.column(2))
        for a, b in words.batches(texts, _CHUNK):
            sign = 0
            for t in texts[a:b]:
                sign = zlib.crc32(t, zlib.crc32(b"%d" % len(t), sign))
            yield f"{TaskContext.get().partitionId()}:{seq}:{sign}", batch.slice(a, b - a), texts[a:b]
            seq += 1


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def grams(docs: DataFrame, classes: int) -> DataFrame:
    """chunk, class, fold, size, keys, counts: the distinct n-grams of each chunk as sorted arrays."""
    import pyarrow as pa

    def run(batches):
        for chunk, _, texts in _chunks(batches):
            for fold in (0, 1):
                key, n = _own(texts, fold)
                order, start = _dealt(key, classes)
                key, n = key[order], n[order]
                rows = [(c, start[c], start[c + 1]) for c in range(classes) if start[c] < start[c + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * len(rows), pa.string()), pa.array([c for c, *_ in rows], pa.int32()),
                        pa.array([fold] * len(rows), pa.int32()), pa.array([int(b - a) for _, a, b in rows], pa.int64()),
                        pa.array([_pack(key[a:b], LONG) for _, a, b in rows], pa.binary()), pa.array([_pack(n[a:b]) for _, a, b in rows], pa.binary()),
                    ],
                    ["chunk", "class", "fold", "size", "keys", "counts"],
                )

    return _read(docs).mapInArrow(run, "chunk string, class int, fold int, size bigint, keys binary, counts binary")


def _levels(key: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of the orders LONG down to ORDER + 1; lower orders count the distinct bytes to the left."""
    levels = [(key, n)]
    for _ in range(LONG - ORDER - 1):
        low, times = np.unique(_less(levels[-1][0]), return_counts=True)
        levels.append((low, times.astype(np.int64)))
    return levels


def _columns(table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def merged(asked: DataFrame) -> DataFrame:
    """class, fold, size, keys, counts of all chunks; low, low_n: continuation counts for order ORDER; seen: counts of counts."""
    import pyarrow as pa

    def run(table):
        rows, out = _columns(table), []
        for fold in (0, 1):
            own = [r for r in rows if r[1] == fold]
            key, n = _summed([_unpack(k, s, LONG) for _, _, s, k, _ in own], [_unpack(c, s).astype(np.int64) for _, _, s, _, c in own])
            levels = _levels(key, n)
            low, low_n = np.unique(_low(levels[-1][0]), return_counts=True)
            seen = [int((c == k).sum()) for _, c in levels for k in range(1, 5)]
            out.append((rows[0][0], fold, len(key), _pack(key, LONG), _pack(n), len(low), _pack(low), _pack(low_n), seen))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["class", "fold", "size", "keys", "counts", "low_size", "low", "low_n", "seen"]
    schema = "class int, fold int, size bigint, keys binary, counts binary, low_size bigint, low binary, low_n binary, seen array<bigint>"
    return asked.select("class", "fold", "size", "keys", "counts").groupBy("class").applyInArrow(run, schema)


def _discounts(n: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) of modified Kneser-Ney from the counts of counts; a little always goes to lower orders."""
    return _discounts_of([float((n == k).sum()) for k in range(1, 5)])


def _discounts_of(seen) -> np.ndarray:
    c = [0.0, *seen]
    if min(c[1:]) == 0:  # too few n-grams for the estimate
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = c[1] / (c[1] + 2 * c[2])
    return np.clip([0.0, 1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3]], [0.0, 0.1, 0.1, 0.1], [0.0, 0.99, 1.99, 2.99])


class Model:
    """The orders up to ORDER: for each the sorted codes and log probabilities, and the sorted contexts and log back-off weights."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        order = np.argsort(code)
        levels = [(code[order].astype(np.int64), n[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols to the left
            low, times = np.unique(levels[0][0] % ALPHABET**k, return_counts=True)
            levels.insert(0, (low, times.astype(np.float64)))
        self.tables = []
        lower = None
        for codes, c in levels:
            d = _discounts(c)[np.minimum(c, 3).astype(int)]
            contexts, at = np.unique(codes // ALPHABET, return_inverse=True)
            total = np.bincount(at, c)
            weight = np.bincount(at, d) / total
            base = 1 / ALPHABET if lower is None else np.exp(lower(codes % (lower.size)))
            logp = np.log(np.maximum((c - d) / total[at] + weight[at] * base, 1e-12))
            self.tables.append((codes.astype(np.int32), logp.astype(np.float32), contexts.astype(np.int32), np.log(np.maximum(weight, 1e-12)).astype(np.float32)))
            lower = _Lower(self, len(self.tables))

    def logp(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last symbol of each code of ``order`` symbols."""
        if order == 0:
            return np.full(len(code), -np.log(ALPHABET), np.float32)
        codes, logp, contexts, weights = self.tables[order - 1]
        if not len(codes):
            return np.full(len(code), -np.log(ALPHABET), np.float32)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        out = logp[at]
        miss = np.flatnonzero(codes[at] != code)
        if len(miss):
            rest = code[miss]
            context = rest // ALPHABET
            where = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            weight = np.where(contexts[where] == context, weights[where], np.float32(0))
            out[miss] = weight + self.logp(rest % ALPHABET ** (order - 1), order - 1)
        return out


class _Lower:
    def __init__(self, model: Model, order: int):
        self.model, self.order, self.size = model, order, ALPHABET**order

    def __call__(self, code):
        return self.model.logp(code.astype(np.int32), self.order)


def low_counts(parts: DataFrame) -> DataFrame:
    """fold, code, n: how many distinct bytes stand before each ORDER-gram; at most 2 * ALPHABET^ORDER rows."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for fold, size, low, n in _columns(batch):
                code = _unpack(low, size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, fold, np.int32)), pa.array(code), pa.array(_unpack(n, size).astype(np.int64))], ["fold", "code", "n"])

    own = parts.select("fold", "low_size", "low", "low_n").mapInArrow(run, "fold int, code int, n bigint")
    return own.groupBy("fold", "code").agg(F.sum("n").alias("n"))


class Long:
    """The orders above ORDER of one class: sorted keys, shares, sorted contexts, back-off weights."""

    def __init__(self, key: np.ndarray, n: np.ndarray, discounts: list[np.ndarray]):
        self.levels = []
        for (codes, c), discount in zip(_levels(key, n), discounts, strict=True):
            d = discount[np.minimum(c, 3)]
            contexts, at = np.unique(codes >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, c)
            self.levels.insert(0, (codes, (c - d) / total[at] if len(codes) else d, contexts, np.bincount(at, d) / total))

    def logp(self, key: np.ndarray, low: Model) -> np.ndarray:
        """Log probability of the last byte of each n-gram."""
        asked = [key]
        while len(asked) < len(self.levels):
            asked.insert(0, _less(asked[0]))
        p = np.exp(low.logp(_low(asked[0])).astype(np.float64))
        for x, (codes, share, contexts, weight) in zip(asked, self.levels, strict=True):
            if not len(codes):
                break
            at = np.minimum(np.searchsorted(codes, x), len(codes) - 1)
            context = x >> np.uint64(8)
            where = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            p = np.where(codes[at] == x, share[at], 0) + np.where(contexts[where] == context, weight[where], 1) * p
        return np.log(np.maximum(p, 1e-12))


def answers(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """chunk, fold, class, size, cost: negative log probabilities of the n-grams that a chunk asked for, in the other fold's model."""
    import pyarrow as pa

    seen = parts.select("fold", F.posexplode("seen").alias("at", "n")).groupBy("fold", "at").agg(F.sum("n").alias("n")).collect()
    times = {(r["fold"], r["at"]): float(r["n"]) for r in seen}
    discounts = [[_discounts_of([times.get((f, 4 * k + i), 0.0) for i in range(4)]) for k in range(LONG - ORDER)] for f in (0, 1)]
    t = low_counts(parts).toArrow()
    fold, code, n = (t.column(c).to_numpy() for c in ("fold", "code", "n"))
    tables = [Model(code[fold == f], n[fold == f]).tables for f in (0, 1)]
    shared = asked.sparkSession.sparkContext.broadcast(tables)

    def run(left, right):
        rows, out = _columns(left), []
        for f, size, keys, counts in _columns(right):
            low = Model.__new__(Model)
            low.tables = shared.value[f]
            long = Long(_unpack(keys, size, LONG), _unpack(counts, size).astype(np.int64), discounts[f])
            for chunk, kind, of, n, packed in rows:
                if of == 1 - f:
                    cost = np.rint(-SCALE * long.logp(_unpack(packed, n, LONG), low)).astype(np.uint64)
                    out.append((chunk, of, kind, n, _pack(cost, 2)))
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "fold", "class", "size", "cost"])

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    left = asked.select("chunk", "class", "fold", "size", "keys").groupBy("class")
    right = parts.select("class", "fold", "size", "keys", "counts").groupBy("class")
    # a group's key comes as a column, too: it is left out on the right
    return left.cogroup(right).applyInArrow(lambda a, b: run(a, b.drop(["class"])), "chunk string, fold int, class int, size bigint, cost binary")


def _repeated_words(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each document the words inside REPEAT_WINDOW-word windows that occur in it twice or more."""
    out = np.zeros(len(off) - 1, np.int64)
    n = len(h) - REPEAT_WINDOW + 1
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    own = np.flatnonzero(doc[:n] == doc[REPEAT_WINDOW - 1 :])
    key = words.mix(words.window_hashes(h, REPEAT_WINDOW)[own] + doc[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at = own[order[twice]]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + REPEAT_WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    return covered[off[1:]] - covered[off[:-1]]


def _duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return n


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_COUNTED = np.zeros(256, bool)  # first bytes of code points that belong to words
_COUNTED[[b for b in range(256) if not (b == 32 or 9 <= b <= 13 or 128 <= b < 192)]] = True

_COLUMNS = ["n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and score: mean negative log probability a byte (null without text)."""
    import pyarrow as pa

    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    classes = max(_CLASSES, 1 << (int(total) // _CLASS_BYTES).bit_length())
    asked = written(grams(docs, classes), "grams")
    told = answers(asked, written(merged(asked), "parts"))

    def bodies(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for chunk, rows, _ in _chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])

    def costs(texts, table):
        """For each fold the sorted keys of a chunk and their costs."""
        rows = _columns(table)
        for fold in (0, 1):
            key, _ = _own(texts, fold)
            order, _ = _dealt(key, classes)
            own = sorted((kind, n, packed) for f, kind, n, packed in rows if f == fold)
            if sum(n for _, n, _ in own) != len(key):
                raise RuntimeError("the documents changed while they were read")
            cost = np.zeros(len(key))
            if len(key):
                cost[order] = np.concatenate([_unpack(packed, n, 2) for _, n, packed in own]) / SCALE
            yield key, cost

    def run(left, right):
        out = []
        for body in left.column("body").to_pylist():
            table = pa.ipc.open_stream(body).read_all()
            texts = words.utf8(table.column("text").combine_chunks())
            known = list(costs(texts, right.select(["fold", "class", "size", "cost"])))
            folds = np.fromiter(map(_fold, texts), np.int8, len(texts))
            parts = []
            for a, b in words.batches(texts, _PIECE):
                part = texts[a:b]
                h, off = words.word_hashes(part, words.SPACED_CASED)
                raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
                ends = np.cumsum([len(t) + 1 for t in part])
                starts = ends - np.array([len(t) + 1 for t in part])
                sums = [np.add.reduceat(m[raw].astype(np.int64), starts) for m in (_COUNTED, _SYMBOLS)]
                size, score = np.fromiter(map(len, part), np.int64, len(part)), np.full(len(part), np.nan)
                for fold, (key, cost) in enumerate(known):
                    mine = np.flatnonzero((folds[a:b] == fold) & (size > 0))
                    if len(mine):
                        own, edge = _keys([part[i] for i in mine])
                        added = np.concatenate(([0], np.cumsum(cost[np.searchsorted(key, own)])))
                        score[mine] = (added[edge[1:]] - added[edge[:-1]]) / size[mine]
                parts.append((size, np.diff(off), *sums, np.fromiter(map(_duplicate_lines, part), np.int64, len(part)), _repeated_words(h, off), score))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            arrays = [pa.array(c.astype(np.int64)) for c in columns[:-1]] + [pa.array(columns[-1].astype(np.float64), from_pandas=True)]
            out.append(pa.Table.from_arrays([table.column("doc_id"), table.column("lang"), *arrays], ["doc_id", "lang", *_COLUMNS]))
        if not out:
            raise RuntimeError("the documents changed while they were read")
        return pa.concat_tables(out)

    kinds = docs.schema
    schema = T.StructType([T.StructField("doc_id", kinds["doc_id"].dataType), T.StructField("lang", T.StringType())])
    for c in _COLUMNS:
        schema = schema.add(c, T.DoubleType() if c == "score" else T.LongType())
    left = _read(docs).mapInArrow(bodies, "chunk string, body binary").groupBy("chunk")
    return left.cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def bands(scores: DataFrame, spread: float = SPREAD) -> DataFrame:
    """lang, middle, down, up: a text of n symbols may score from middle - down / sqrt(n) to middle + up / sqrt(n)."""
    counted = scores.filter((F.col("n_words") >= MIN_WORDS) & F.col("score").isNotNull())
    middle = counted.groupBy("lang").agg(F.percentile_approx("score", 0.5, 2000).alias("middle"))
    known = F.col("lang").eqNullSafe(F.col("_lang"))
    placed = counted.join(middle.withColumnRenamed("lang", "_lang"), known)
    off = (F.col("score") - F.col("middle")) * F.sqrt(F.col("n_bytes"))
    q = placed.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx(off, [0.25, 0.75], 2000).alias("q"))
    wide = (F.col("q")[1] - F.col("q")[0]) * spread
    return q.select("lang", "middle", (wide - F.col("q")[0]).alias("down"), (wide + F.col("q")[1]).alias("up"))


def judged(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """doc_id, lang, base counts, base_failed, score, perplexity, low, high, kept."""
    scores = written(scored(docs), "perplexity")
    limits = bands(scores, spread).withColumnRenamed("lang", "_lang")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    joined = scores.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    root = F.sqrt(F.greatest("n_bytes", F.lit(1)))
    joined = joined.withColumn("low", F.col("middle") - F.col("down") / root - SLACK)
    joined = joined.withColumn("high", F.col("middle") + F.col("up") / root + SLACK)
    inside = F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("base_failed", failed).withColumn("perplexity", F.exp("score")).withColumn("kept", ~failed & inside)
