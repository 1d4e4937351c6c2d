import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cipherledger.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def brute_pieces(tokenizer, rows, capacity):
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check_packing(rows, capacity):
    """No overlap, no gap, nothing beyond the capacity; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def first_fit(lengths, capacity):
    space = []
    for l in sorted(lengths, reverse=True):
        for i, s in enumerate(space):
            if s >= l:
                space[i] -= l
                break
        else:
            space.append(capacity - l)
    return len(space)


def test_words_encode_as_the_whole_text(tokenizer, odd_rows):
    texts = [t for _, t, _, _ in odd_rows] + [
        "<|endoftext|> a\0b \0 x", "\x1ca\x1d b\x85c\xa0d e　", "ÀÉ É ́x É's we'LL don't 123 ½ ﬁ", "x" * 70 + " " + "y" * 5000,
        "İSTANBUL ΣΑΣ 日本語", "a\nb\tc\x0bd\r\n", "end. end, END; end",
    ]
    v = packing.Vocabulary(open(PATH, "rb").read())
    for _ in range(2):
        for text, ids in zip(texts, v.encode(texts), strict=True):
            assert tokenizer.encode(text or "", add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()
        v.old, v.young = v.young, {}


def test_best_configuration_equals_exhaustive_search():
    rng = random.Random(4)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(5, 30), 4), reverse=True))
        price = np.array([rng.random() * s for s in sizes])
        best = 0.0

        def search(k, left, worth):
            nonlocal best
            best = max(best, worth)
            for i in range(k, 4):
                if sizes[i] <= left:
                    search(i, left - sizes[i], worth + price[i])

        search(0, 60, 0.0)
        worth, places = packing.best_configuration(sizes, price, 60)
        assert worth == pytest.approx(best) and (places * sizes).sum() <= 60 and (places * price).sum() == pytest.approx(best)


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 100, 256])
    counts = {l: rng.choice([0, 1, 3, 50, 400]) for l in rng.sample(range(1, capacity + 1), 40)}
    plan = packing.plan(counts, capacity, many=16)
    rows = [
        {"length": l, "sequence_id": first + i // per, "offset": offset + i % per * l, "rank": rank + i}
        for l, rank, n, first, per, offset in plan.runs for i in range(n)
    ]
    assert sorted((r["length"], r["rank"]) for r in rows) == sorted((l, i) for l, n in counts.items() for i in range(n))
    used = check_packing(rows, capacity)
    assert used == plan.sequences
    lengths = [r["length"] for r in rows]
    # configurations need room to pay: within a twentieth and one sequence a group of first fit, never below the sum
    assert -(-sum(lengths) // capacity) <= used <= first_fit(lengths, capacity) * 1.05 + 16


def test_configurations_are_optimal_where_sizes_divide_well():
    # 1000 of 60 and 2000 of 20 into 100: 60 + 20 + 20 fills every sequence
    assert packing.plan({60: 1000, 20: 2000}, 100, small=10, many=3).sequences == 1000


def test_a_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(2)
    counts = {l: rng.randint(1, 9) for l in range(1, 256)}
    small, large = packing.plan(counts, 256), packing.plan({l: n * 10**9 for l, n in counts.items()}, 256)
    assert len(large.runs) < 2 * len(small.runs) + 1000
    assert large.sequences <= 1.02 * sum(l * n * 10**9 for l, n in counts.items()) / 256


@pytest.mark.parametrize("capacity", [32, 2048])
def test_packed_documents(spark, frame, odd_rows, vocabulary, tokenizer, capacity):
    rng = random.Random(6)
    rows = odd_rows + [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))), "en", "a") for i in range(120)]
    rows += [(500, "the very same text", "en", "a")] * 150  # a hot length
    got = packing.packed(frame(rows), PATH, capacity).collect()
    digest = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str)
    assert digest == brute_pieces(tokenizer, [(i, t) for i, t, _, _ in rows], capacity)
    used = check_packing([r.asDict() for r in got], capacity)
    assert used <= first_fit([r["length"] for r in got], capacity) * 1.05 + 1


def test_no_documents(no_rows):
    out = packing.packed(no_rows, PATH)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0
