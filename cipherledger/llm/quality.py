"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes N_STATS statistics (lengths, shares of character classes, lines,
repetition). Cosines of random projections approximate a Gaussian kernel over the
standardised statistics. The normal equations of the ridge regression are sums
over partitions: each task adds up its own and Spark sums them by cell, so all
labelled rows are used and the driver gets one matrix of fixed size. Raw scores
are then calibrated by isotonic regression over BINS equal-width bins.

Defined results: null text is the empty text, and empty texts are scored like any
other; a document labelled more than once counts once for each label row; rows
without a label are not learned from; without any labelled row every score is 0.5;
repeated rows repeat their scores; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.llm import words
from cipherledger.session import written

FEATURES = 256  # random cosines
BANDWIDTH = 4.0
RIDGE = 1e-3  # a labelled row
BINS = 512
SEED = 11

_CLASSES = np.full(256, 7, np.int64)
_CLASSES[97:123] = 0
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[32] = 3
_CLASSES[10] = 4
_CLASSES[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASSES[[ord(c) for c in "!?"]] = 6
_CLASSES[[ord(c) for c in "#*$%&|<>"]] = 8
_CLASSES[128:] = 9
N_STATS = 10 + 9


def statistics(text: bytes) -> list[float]:
    """N_STATS numbers that describe a text; all zero for the empty text."""
    if not text:
        return [0.0] * N_STATS
    n = len(text)
    classes = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=10) / n
    tokens = text.split()
    lines = text.split(b"\n")
    k = len(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, k) if k else np.zeros(1)
    kinds = len(set(tokens))
    filled = [x for x in lines if x.strip()]
    repeats = 1 - len(set(filled)) / len(filled) if filled else 0.0
    trigrams = set(zip(tokens, tokens[1:], tokens[2:], strict=False))
    return [
        *np.sqrt(classes), np.log1p(n), np.log1p(k), sizes.mean(), sizes.std(), kinds / max(k, 1),
        np.log1p(n / len(lines)), repeats, 1 - len(trigrams) / max(k - 2, 1) if k > 2 else 0.0, float(np.log1p(sizes.max())),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            stats = [statistics(t) for t in words.utf8(batch.column(1))]
            flat = pa.array(np.array(stats, np.float64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * N_STATS), flat)], ["doc_id", "stats"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


class Scorer:
    """Standardisation, projection, ridge weights and calibration; a few hundred kilobytes."""

    def __init__(self, mean, scale):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.project = rng.normal(0, 1 / BANDWIDTH, (N_STATS, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.edges, self.values = np.zeros(1), np.full(1, 0.5)

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.project + self.phase) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_STATS)


def isotonic(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of total / weight by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for t, w in zip(total, weight, strict=True):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), t / w) for t, w, k in blocks])


def fit(rows: DataFrame) -> Scorer:
    """A scorer from rows of (stats, label 0 or 1)."""
    import pyarrow as pa

    one = rows.select(*[F.col("stats")[i].alias(f"s{i}") for i in range(N_STATS)]).agg(
        F.count("*"), *[F.avg(f"s{i}") for i in range(N_STATS)], *[F.stddev_pop(f"s{i}") for i in range(N_STATS)]
    ).first()
    n = one[0]
    if not n:
        return Scorer(np.zeros(N_STATS), np.ones(N_STATS))
    scorer = Scorer(one[1 : N_STATS + 1], [max(s, 1e-6) for s in one[N_STATS + 1 :]])
    d = FEATURES + 1
    side = np.triu_indices(d)

    def partial(batches):
        gram, right = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                z = scorer.cosines(_matrix(batch.column(0)))
                gram += z.T @ z
                right += z.T @ np.asarray(batch.column(1))
        flat = np.concatenate((gram[side], right))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "value"])

    sums = rows.select("stats", F.col("label").cast("double")).mapInArrow(partial, "cell bigint, value double")
    got = sums.groupBy("cell").agg(F.sum("value").alias("value")).toArrow().sort_by("cell").column("value").to_numpy()  # one matrix
    gram = np.zeros((d, d))
    gram[side] = got[: len(side[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    scorer.weights = np.linalg.solve(gram + RIDGE * n * np.eye(d) / d, got[len(side[0]) :])

    def raws(batches):
        for batch in batches:
            r = scorer.raw(_matrix(batch.column(0))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((r + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), pa.array(r), batch.column(1)], ["bin", "raw", "label"])

    binned = rows.select("stats", F.col("label").cast("double")).mapInArrow(raws, "bin int, raw double, label double")
    bins = binned.groupBy("bin").agg(F.sum("label"), F.count("*"), F.avg("raw")).orderBy("bin").collect()  # BINS rows at most
    scorer.values = np.clip(isotonic(np.array([b[1] for b in bins]), np.array([b[2] for b in bins], float)), 0, 1)
    scorer.edges = np.array([b[3] for b in bins])
    return scorer


def scores(stats: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score between 0 and 1."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            s = scorer.score(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    out = T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return stats.select("doc_id", "stats").mapInArrow(run, out)


def classify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, score of all documents; learned from ``labelled`` (doc_id, label)."""
    stats = written(described(docs), "statistics")
    known = labelled.filter("label is not null and doc_id is not null").select(F.col("doc_id").alias("_doc"), "label")
    return scores(stats, fit(stats.join(known, F.col("doc_id") == F.col("_doc")).select("stats", "label")))
