"""Fuzzy search for short license notices.

A notice of m characters may be found with up to m // EDIT_SHARE edits. It is split
into one piece more than that, so at least one piece stands unchanged in any match
(pigeonhole); pieces are looked up exactly in the normalised text and give candidate
places. A candidate is an exact occurrence, or the ``regex`` library's bounded-error
matching verifies it inside a window around it and reports its edits and span.

The normalised text is the words (runs of ASCII letters and digits, lower-cased, and
of anything beyond ASCII) joined by single spaces; matches start and end at word
bounds. Phrases of the base are notices too; their exact places are those of the base.

Defined results: null is the empty text, which has no words and no places; repeated
rows repeat their results; an empty table gives an empty table; other columns are
ignored. Work is linear in the text and in the number of candidates.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.llm import words

EDIT_SHARE = 10

#: phrases whose exact places are counted, and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: notices that are searched with edits besides the base phrases
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


class Notice:
    """A phrase with its label, pieces and verifying pattern."""

    def __init__(self, phrase: str, label: str, base: bool):
        self.text, self.label, self.base = phrase.encode(), label, base
        n = len(self.text)
        self.edits = n // EDIT_SHARE
        cuts = [n * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(b"(?e)(?<= )(?:" + regex.escape(self.text, literal_spaces=True) + b"){e<=%d}(?= )" % self.edits)

    def places(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of all matches in a normalised text that starts and ends with a space."""
        n, starts = len(self.text), set()
        for piece, at in self.pieces:
            found = text.find(piece)
            while found >= 0:
                starts.add(found - at)
                found = text.find(piece, found + 1)
        exact = [s for s in starts if s > 0 and text[s - 1 : s + n + 1] == b" " + self.text + b" "]
        out = [(s, s + n, 0) for s in exact]
        known, done = set(exact), -1
        for s in sorted(starts):
            if s + n <= done or not self.edits or any(s + d in known for d in range(-self.edits, self.edits + 1)):
                continue
            low = max(0, s - self.edits - 1)
            m = self.pattern.search(text, low, min(len(text), s + n + self.edits + 1))
            if m and (m.start() not in known):
                known.add(m.start())
                done = m.end()
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(out)


def _notices() -> list[Notice]:
    return [Notice(p, x, True) for p, x in BASE.items()] + [Notice(p, x, False) for p, x in NOTICES.items()]


def _closest(found: list[tuple]) -> list[tuple]:
    """Places without those that overlap a place of another label with fewer edits: the nearer notice is meant."""
    reach = max((len(f[3].text) + f[3].edits for f in found), default=0)
    kept, starts = [], []  # starts of kept places, sorted; an overlapping one starts within reach
    for f in sorted(found, key=lambda f: f[2]):
        near = starts[bisect_left(starts, (f[0] - reach,)) : bisect_left(starts, (f[1],))]
        if not any(end > f[0] and edits < f[2] and label != f[3].label for _, end, edits, label in near):
            kept.append(f)
            insort(starts, (f[0], f[1], f[2], f[3].label))
    return kept


def find(text: bytes, notices: list[Notice]) -> tuple[int, list[dict]]:
    """(number of words, places as label, base, start and end in words, edits, share of unchanged characters, text)."""
    tokens = text.translate(words.ALNUM).split()
    joined = b" " + b" ".join(tokens) + b" "
    found = [(s, e, k, x) for x in notices for s, e, k in x.places(joined)]
    out, at, word = [], 0, 0
    for s, e, k, x in sorted(_closest(found), key=lambda f: f[:3]):
        word += joined.count(b" ", at, s)
        at = s
        out.append(
            {"label": x.label, "base": x.base and k == 0, "start": word - 1, "end": word - 1 + joined.count(b" ", s, e) + 1, "edits": k,
             "share": max(0.0, 1 - k / len(x.text)), "matched": joined[s:e].decode(errors="replace")}
        )
    return len(tokens), out


_PLACE = T.StructType().add("label", "string").add("base", "boolean").add("start", "long").add("end", "long")
_PLACE = _PLACE.add("edits", "integer").add("share", "double").add("matched", "string")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (label, base, start, end, edits, share, matched) of every row."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()),
        ("share", pa.float64()), ("matched", pa.string()),
    ]))

    def run(batches):
        notices = _notices()
        for batch in batches:
            got = [find(t, notices) for t in words.utf8(batch.column(1))]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)
