"""Centroid clustering of integer vectors by bit planes and popcounts.

A component x counts as the integer floor(64 * x). Bit plane p of a vector is one
64-bit word: bit j tells whether component j has bit p in two's complement. With
weight(p) = 2^p, and -2^p for the sign plane,

    dot(x, c) = sum over p, q of weight(p) * weight(q) * popcount(x[p] AND c[q])

so distances come exactly from ANDs and popcounts of a few words a vector. Vectors
are packed once into a table of planes and squared norms; a round reads only that
table, and its tasks return sums of their own for each centroid, so what reaches the
driver is COUNT rows of 64 sums whatever the number of vectors.

Defined results: vectors without exactly 64 components, or with a null, NaN or
infinite one, are left out; integers beyond 2^27 count as 2^27, so that distances fit
in 64 bits; repeated rows count as often as they stand; ties go to the smaller
centroid, equal start hashes to the smaller components; with fewer than COUNT vectors
there are as many centroids as vectors; a null vec_id hashes as the empty string; an
empty table gives an empty table; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.session import written

SIZE = 64  # components: one word a plane
COUNT = 16
ROUNDS = 3
LARGEST = 1 << 27
SLICE = 4096  # vectors that a task holds against the centroids at once


def weights(width: int) -> np.ndarray:
    """Of the planes of a two's complement number of ``width`` bits."""
    out = np.left_shift(np.int64(1), np.arange(width, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """(n, 64) integers to (n, width) planes, with the least width that holds all of them."""
    width = int(np.abs(values).max(initial=0)).bit_length() + 1
    bits = (values[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpacked_sums(planes: np.ndarray) -> np.ndarray:
    """Componentwise sums of the vectors, from the number of set bits of each plane and component."""
    bits = np.unpackbits(planes[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return weights(planes.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


def dots(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """(n, width) and (k, width) planes to (n, k) dot products."""
    out = np.zeros((len(planes), len(others)), np.int64)
    for p, a in enumerate(weights(planes.shape[1])):
        for q, b in enumerate(weights(others.shape[1])):
            out += (a * b) * np.bitwise_count(planes[:, p, None] & others[None, :, q]).astype(np.int64)
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(planes), np.int64)
    w = weights(planes.shape[1])
    for p in range(len(w)):
        for q in range(len(w)):
            out += (w[p] * w[q]) * np.bitwise_count(planes[:, p] & planes[:, q]).astype(np.int64)
    return out


def _read(column) -> np.ndarray:
    """Planes of a batch; narrower ones repeat their sign plane."""
    rows = [np.frombuffer(x, "<u8") for x in column.to_pylist()]
    width = max(map(len, rows))
    return np.stack([x if len(x) == width else np.concatenate([x, np.repeat(x[-1:], width - len(x))]) for x in rows])


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id and components x (array<double>) of the vectors that count."""
    x = F.col("x")
    whole = (F.size(x) == SIZE) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return vectors.select("vec_id", vectors["embedding"].cast("array<double>").alias("x")).filter(x.isNotNull() & whole)


def packed(rows: DataFrame) -> DataFrame:
    """vec_id, planes (binary, 8 bytes a plane) and norm (long) of the rows of ``kept``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            planes = pack(np.clip(np.floor(flat * 64.0), -LARGEST, LARGEST).astype(np.int64))
            rows = [r.tobytes() for r in planes.astype("<u8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(norms(planes))], ["vec_id", "planes", "norm"])

    out = T.StructType([rows.schema["vec_id"], T.StructField("planes", T.BinaryType()), T.StructField("norm", T.LongType())])
    return rows.mapInArrow(run, out)


def start(rows: DataFrame, count: int = COUNT) -> np.ndarray:
    """The integers of the ``count`` rows of ``kept`` with the smallest sha256 of ``1:<vec_id>``."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole = F.transform("x", lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c * 64.0))).cast("long"))
    first = rows.select(key.alias("key"), whole.alias("v")).orderBy("key", "v").limit(count).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(-1, SIZE)


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector."""
    far = norm[:, None] + (centroids**2).sum(axis=1)[None, :] - 2 * dots(planes, pack(centroids))
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0), _read(part.column(1)), part.column(2).to_numpy()


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; those without vectors stay."""
    import pyarrow as pa

    def run(batches):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, planes, norm in _slices(batches):
            best, _ = nearest(planes, norm, centroids)
            for k in np.unique(best):
                n[k] += int((best == k).sum())
                sums[k] += unpacked_sums(planes[best == k])
        used = np.flatnonzero(n)
        lists = pa.array(sums[used].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), lists], ["k", "n", "sums"])

    parts = rows.mapInArrow(run, "k int, n long, sums array<long>").select("k", "n", F.posexplode("sums").alias("j", "s"))
    out = centroids.copy()
    for r in parts.groupBy("k", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # 64 rows a centroid
        out[r["k"], r["j"]] = r["s"] // r["n"]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, centroid_sha256."""
    import pyarrow as pa

    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches):
        for ids, planes, norm in _slices(batches):
            best, far = nearest(planes, norm, centroids)
            columns = [ids, pa.array(best.astype(np.int32)), pa.array(far), pa.array([names[k] for k in best])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "centroid_sha256"])

    out = T.StructType([
        rows.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
        T.StructField("centroid_sha256", T.StringType()),
    ])
    return rows.mapInArrow(run, out)


def clusters(vectors: DataFrame, count: int = COUNT, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    whole = kept(vectors)
    rows, centroids = written(packed(whole), "planes"), start(whole, count)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)
    out = assigned(rows, centroids)
    inertia = [(k, F.lit(n)) for k, n in out.groupBy("cluster").agg(F.sum("distance")).collect()]  # a row a centroid
    total = F.lit(None).cast("long")
    by_cluster = total
    for k, n in inertia:
        by_cluster = F.when(F.col("cluster") == k, n.cast("long")).otherwise(by_cluster)
        total = F.coalesce(total, F.lit(0)) + n.cast("long")
    return out.withColumns({"cluster_inertia": by_cluster, "inertia": total})
