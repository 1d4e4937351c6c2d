"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRU cells of HIDDEN units read a segment of SEGMENT bytes from both ends; at
every position a linear layer on both states gives a distribution over languages.
A document's distribution is the mean over all positions of all its segments, so
whole texts count, whatever their length. The network is trained in numpy by
backpropagation through time and Adam on the driver, from a bounded sample: at
most SAMPLE documents of each language, chosen by a hash of doc_id, and EXCERPT
characters of each. Prediction runs over all rows in Arrow batches, many segments
at a time.

Defined results: ``und`` with score 0 if the text is null, empty or without a
letter, or if nothing could be learned; ties go to the language first in order;
repeated rows repeat their result; an empty table gives an empty table; columns
other than doc_id, text and (for training) lang are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.llm import words

HIDDEN = 8
SEGMENT = 128
TRAIN_SEGMENT = 64
SAMPLE = 300
EXCERPT = 1024
STEPS = 350
BATCH = 128
RATE = 0.02
UNKNOWN = "und"


class Network:
    """Parameters and passes. Gates are hard sigmoids, candidates tanh; arrays are (units, segments)."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(languages)
        self.languages = languages
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, h**-0.5, (3 * h, h)).astype(np.float32)
            self.p[f"v{d}"] = rng.normal(0, h**-0.5, (k, h)).astype(np.float32)
        self.p["c"] = np.zeros((k, 1), np.float32)

    def _cell(self, d: str, symbols: np.ndarray, keep: list | None = None):
        """States after each row of ``symbols`` (time, segments), in reading order."""
        h, x, u = HIDDEN, self.p[f"x{d}"], self.p[f"u{d}"]
        n = symbols.shape[1]
        state = np.zeros((h, n), np.float32)
        fed, gates = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        for row in symbols:
            np.take(x, row, axis=1, out=fed, mode="clip")
            np.matmul(u, state, out=gates)
            zr = gates[: 2 * h]
            zr += fed[: 2 * h]
            zr *= 0.25
            zr += 0.5
            np.minimum(zr, 1, out=zr)
            np.maximum(zr, 0, out=zr)
            new = gates[2 * h :]
            if keep is not None:
                keep.append([row, state.copy(), zr.copy(), new.copy()])
            new *= zr[h:]
            new += fed[2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep[-1].append(new.copy())
            state -= new
            state *= zr[:h]
            state += new
            yield state

    def pooled(self, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed position distributions (segments, languages); ``segments`` is (segments, time)."""
        t = segments.shape[1]
        symbols = np.ascontiguousarray(segments.T).astype(np.intp)
        logits = np.empty((t, len(self.languages), len(segments)), np.float32)
        for i, state in enumerate(self._cell("f", symbols)):
            np.matmul(self.p["vf"], state, out=logits[i])
        logits += self.p["c"]
        total = np.zeros((len(self.languages), len(segments)), np.float32)
        for i, state in zip(range(t - 1, -1, -1), self._cell("b", symbols[::-1]), strict=True):
            e = logits[i]
            e += self.p["vb"] @ state
            e -= e.max(0)
            np.exp(e, out=e)
            e *= (i < lengths) / e.sum(0)
            total += e
        return total.T

    def gradients(self, segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        n, t = segments.shape
        symbols = np.ascontiguousarray(segments.T).astype(np.intp)
        kept = {"f": [], "b": []}
        states = {d: [s.copy() for s in self._cell(d, symbols if d == "f" else symbols[::-1], kept[d])] for d in "fb"}
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        count, loss = max(1, int(lengths.sum())), 0.0
        into = {"f": [], "b": []}
        for i in range(t):
            a, b = states["f"][i], states["b"][t - 1 - i]
            e = self.p["vf"] @ a + self.p["vb"] @ b + self.p["c"]
            e = np.exp(e - e.max(0))
            e /= e.sum(0)
            live = (i < lengths).astype(np.float32)
            loss -= float((np.log(e[labels, np.arange(n)] + 1e-9) * live).sum())
            e[labels, np.arange(n)] -= 1
            e *= live / count
            g["vf"] += e @ a.T
            g["vb"] += e @ b.T
            g["c"] += e.sum(1, keepdims=True)
            into["f"].append(self.p["vf"].T @ e)
            into["b"].append(self.p["vb"].T @ e)
        into["b"].reverse()
        for d in "fb":
            self._back(d, kept[d], into[d], g)
        return loss / count, g

    def _back(self, d: str, kept: list, into: list, g: dict) -> None:
        h, u = HIDDEN, self.p[f"u{d}"]
        carried = np.zeros_like(into[0])
        for (row, before, zr, inner, new), own in zip(reversed(kept), reversed(into), strict=True):
            carried = carried + own
            z, r = zr[:h], zr[h:]
            dnew = carried * (1 - z) * (1 - new * new)
            dz = carried * (before - new)
            dr = dnew * inner
            open_gate = ((zr > 0) & (zr < 1)) * np.float32(0.25)
            dpre = np.concatenate((dz * open_gate[:h], dr * open_gate[h:], dnew))
            np.add.at(g[f"x{d}"].T, row, dpre.T)
            drec = dpre.copy()
            drec[2 * h :] *= r
            g[f"u{d}"] += drec @ before.T
            carried = carried * z + u.T @ drec


def train(texts: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 5) -> Network | None:
    """A network from (language, text) pairs; None without any text."""
    languages = sorted({name for name, text in texts if text})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    by = [[t[i : i + TRAIN_SEGMENT] for name, t in texts if name == x for i in range(0, len(t), TRAIN_SEGMENT)] for x in languages]
    net = Network(languages, seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), BATCH)
        chosen = [by[k][rng.integers(len(by[k]))] for k in labels]
        segments, lengths = _padded(chosen, TRAIN_SEGMENT)
        _, g = net.gradients(segments, lengths, labels)
        rate = RATE * (1 - step / (steps + 1))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x *= min(1.0, 1 / (norm + 1e-9))
            first[k] += 0.1 * (x - first[k])
            second[k] += 0.01 * (x * x - second[k])
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _padded(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    return out, np.array([len(p) for p in pieces])


def _distributions(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean position distribution of each text, block by block of segments."""
    k = len(net.languages)
    block = int(np.clip((1 << 21) // (k * SEGMENT), 64, 4096))
    sums = np.zeros((len(texts), k))
    owners, pieces = [], []

    def flush():
        segments, lengths = _padded(pieces, SEGMENT)
        np.add.at(sums, owners, net.pooled(segments, lengths))
        owners.clear()
        pieces.clear()

    for i, t in enumerate(texts):
        for at in range(0, len(t), SEGMENT):
            owners.append(i)
            pieces.append(t[at : at + SEGMENT])
            if len(pieces) == block:
                flush()
    if pieces:
        flush()
    return sums / np.maximum(sums.sum(1, keepdims=True), 1e-9)


def sample(labelled: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(lang, excerpt) of at most ``per_language`` rows of each language; the ranking is cut off inside every task."""
    usable = labelled.filter("lang is not null and length(text) > 0").select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("_at"),
        F.col("text").cast("string").alias("text"),
    )
    start = F.pmod(F.col("_at"), F.greatest(F.lit(1), F.length("text") - EXCERPT)).cast("int") + 1
    cut = usable.select("lang", "_at", F.substring("text", start, F.lit(EXCERPT)).alias("excerpt"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_at"))).filter(F.col("_rank") <= per_language)
    return [(r[0], r[1].encode()) for r in ranked.select("lang", "excerpt").orderBy("lang", "_at").collect()]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (the winner's share) of every row."""
    return with_language(docs.select("doc_id", "text"), net).drop("text")


def with_language(docs: DataFrame, net: Network | None, name: str = "lang_pred", share: str = "score") -> DataFrame:
    """All columns of ``docs`` and, after them, the language and its share."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(net)
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(share, T.DoubleType())])
    place = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = words.utf8(batch.column(place))
            lettered = np.asarray(batch.column(batch.num_columns - 1))
            names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            asked = np.flatnonzero(lettered) if own is not None else []
            if len(asked):
                p = _distributions(own, [texts[i] for i in asked])
                names[asked] = np.array(own.languages, object)[p.argmax(1)]
                score[asked] = p.max(1)
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return docs.select("*", letter.alias("_letter")).mapInArrow(run, out)
