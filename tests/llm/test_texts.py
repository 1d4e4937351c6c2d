"""Operators that work text by text."""

import base64
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cipherledger.llm import bpe, decontaminate, disclosure, language, license_scan, perplexity, quality, sharding, words

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1 license scans


def test_license_places(frame, odd_rows, no_rows):
    texts = [
        "All rights reserved. GNU General Public License, CC-BY; cc by", "Relesed under the MIT Licence today", "all rights\nreserved " * 40,
        "Licensed under the Apache Licence, Version 2.0", "nothing of the kind", "permission is hereby granted, free of charge, to any pe rson obtaining a copy",
    ]
    rows = odd_rows + [(20 + i, t, "en", "z") for i, t in enumerate(texts)]
    df = license_scan.scan(frame(rows))
    got = df.collect()
    assert len(got) == len(rows)
    expected = {i: brute.licenses(t) for i, t, *_ in rows}
    for r in got:
        base = [p for p in r.places if p.base]
        starts = [p.start for p in base]
        assert (r.n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({p.label for p in base}))) == expected[r.doc_id]
    found = {r.doc_id: {(p.label, p.edits) for p in r.places} for r in got}
    assert ("mit", 2) in found[21] and ("apache", 1) in found[23] and not found[24] and {x for x, _ in found[25]} == {"mit"}
    assert license_scan.scan(no_rows).collect() == []


# 3 language identification


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(language, "HIDDEN", 3)
    net = language.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    segments, lengths, labels = rng.integers(97, 100, (3, 5)).astype(np.uint8), np.array([5, 3, 4]), np.array([0, 1, 1])
    _, g = net.gradients(segments, lengths, labels)
    for k, v in net.p.items():
        for i in [i for i in np.ndindex(v.shape) if abs(g[k][i]) > 1e-4][:3]:
            old, ends = v[i], []
            for d in (1e-2, -1e-2):
                v[i] = old + d
                ends.append(net.gradients(segments, lengths, labels)[0])
            v[i] = old
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[k][i], rel=0.05, abs=1e-4)


def test_languages_of_held_out_texts(frame, odd_rows, no_rows):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "and", "tion", "wh"], "de": ["ung", "sch", "der", "ü", "keit"]}
    make = lambda x: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(100 + i, make(x), x, "s") for i in range(80) for x in [("en", "de")[i % 2]]]
    net = language.train(language.sample(frame(rows[:40])), steps=60)
    got = by_id(language.identify(frame(rows[40:] + odd_rows), net))
    assert sum(got[i].lang_pred == x for i, _, x, _ in rows[40:]) >= 39
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and got[6].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(no_rows, net).collect() == []
    assert language.train(language.sample(no_rows)) is None
    assert {r.lang_pred for r in language.identify(frame(rows[:3]), None).collect()} == {"und"}


# 4 personal data


def test_personal_data_and_disclosing_terms(frame, odd_rows, no_rows):
    rng = random.Random(5)
    common = ["the", "and", "of", "with", "near", "over"]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [f"{fill(30)} quokkalover {fill(2)} jo.doe@site.example.com {fill(3)} rarely{i} {fill(20)}" for i in range(6)]
    texts += [f"{fill(60)} other{i}" for i in range(40)]
    texts += [
        "a@b.c_d@e.f and x@y and 1.2.3.4.5.6.7.8 and 999.1.1.1, card 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (222) 333-4444 é +12 3",
        "+" * 300 + "12345678901234567890123", "0.00.000.0255 1.2.3", "9" * 5000 + " " + "a." * 3000 + "@" + "b-" * 3000,
    ]
    rows = odd_rows + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = disclosure.listed(frame(rows)).collect()
    assert len(got) == len(rows)
    expected = {i: brute.personal(t)[0] for i, t, *_ in rows}
    for r in got:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.place <= 4) == expected[r.doc_id]
    source = {i: t for i, t, *_ in rows}
    extra = {(s.kind, source[r.doc_id][s.start : s.end]) for r in got for s in r.spans if s.place > 4}
    assert extra == {("remove", "quokkalover")}
    clean = by_id(disclosure.sanitised(frame(rows)))
    assert "quokkalover" not in clean[100].text and "[EMAIL]" in clean[100].text and "rarely0" in clean[100].text
    assert clean[4].text == source[4] and clean[1].text == ""
    assert disclosure.listed(no_rows).collect() == []


def test_disclosing_terms_by_brute_force(frame, odd_rows, vocabulary):
    """Whole texts: values seen once, places far from the value, copies, shared values, many values and many rare words in one text."""
    rng = random.Random(15)

    def fill(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    values = [f"user{i}@mail.example.org" for i in range(12)] + [f"10.2.{i}.7" for i in range(8)]
    texts = [f"Blauwal {fill(300)} call +49 30 1234567 walross {fill(300)} blauwal, walross Walross"]  # one text holds the value, 2000 characters away
    texts += [f"{fill(40)} {' '.join(rng.sample(values, rng.randint(1, 3)))} {fill(rng.randint(5, 90))} tag{rng.randint(0, 9)}x tag{rng.randint(0, 30)}y" for _ in range(60)]
    texts += [f"{fill(50)} tag{i % 10}x" for i in range(9)]
    texts += [" ".join(f"list{i}@many.example.org word{i}q word{i}q" for i in range(150)), "single odd@one.example.org hapaxword"]
    texts += [texts[0]] * 5 + [texts[3]] * 4
    rows = odd_rows + [(1000 + i, t, "en", "s") for i, t in enumerate(texts)]
    expected = brute.disclosed([t for _, t, *_ in rows])
    got = disclosure.listed(frame(rows)).collect()
    source = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert {(s.kind, s.start, s.end) for s in r.spans if s.place > 4} == expected.get(source[r.doc_id], set())
    marked = {(r.doc_id, s.kind, source[r.doc_id][s.start : s.end]) for r in got for s in r.spans if s.place > 4}
    assert {(1000, "generalise", "Blauwal"), (1000, "generalise", "blauwal")} <= marked
    assert (1000, "remove", "Walross") in marked and not any(w == "hapaxword" for _, _, w in marked)
    bare = {i for i, t, *_ in rows if not brute.personal(t)[0]}
    assert not bare & {i for i, *_ in marked}


# 5 sharding


def test_shards_fit_and_only_full_buckets_split(frame, odd_rows, no_rows, vocabulary):
    rng = random.Random(3)
    rows = odd_rows + [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60))), "en", "s") for i in range(300)] + [(7777, "same text", "en", "s")] * 200
    limit = 1500
    got = sharding.shards(frame(rows), limit).collect()
    assert len(got) == len(rows)
    sizes, count = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
        count[r.shard] = count.get(r.shard, 0) + 1
        assert len(r.shard) == r.depth
    assert all(r.shard_bytes == sizes[r.shard] and r.oversized == (sizes[r.shard] > limit) for r in got)
    assert all(s <= limit or count[k] == 1 for k, s in sizes.items())
    first = min(map(len, sizes))
    for k in sizes:  # no two buddies could have stayed one shard, and no shard is inside another
        assert not any(k != o and o.startswith(k) for o in sizes)
        if len(k) > first:
            assert sum(s for o, s in sizes.items() if o.startswith(k[:-1])) > limit
    assert sharding.shards(no_rows).collect() == []


# 7 perplexity


def test_rules_and_bands(frame, odd_rows, no_rows, vocabulary):
    rng = random.Random(4)
    rows = odd_rows + [(100 + i, " ".join(rng.choices(vocabulary, k=80)), "en", "s") for i in range(60)]
    rows += [(200, "a b c d e f g h i\n" * 30, "en", "s"), (201, "zq&* %%|<# xx\n\nzq&* %%|<# xx\n \n " * 3, "en", "s")]
    rows += [(202, " ".join("".join(rng.choice("QZXVKJ#$%") for _ in range(9)) for _ in range(200)), "en", "s")]
    got = perplexity.judged(frame(rows)).collect()
    assert len(got) == len(rows)
    expected = {i: brute.rules(t) for i, t, *_ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[100 + i] for i in range(60)) and not kept[200] and not kept[202] and not kept[1]
    assert perplexity.judged(no_rows).collect() == []


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, perplexity.ALPHABET**perplexity.ORDER, 3000)).astype(np.int32)
    model = perplexity.Model(code, rng.integers(1, 9, len(code)))
    for context in [*(code[:3] // perplexity.ALPHABET), 17]:
        every = np.int32(context) * perplexity.ALPHABET + np.arange(perplexity.ALPHABET, dtype=np.int32)
        assert np.exp(model.logp(every).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_scores_are_those_of_the_other_fold(frame, odd_rows, vocabulary):
    rng = random.Random(14)
    rows = odd_rows[:6] + odd_rows[8:] + [(100 + i, " ".join(rng.choices(vocabulary, k=40)), "en", "s") for i in range(30)]
    texts = {(t or "").encode() for _, t, *_ in rows}
    models = [brute.kneser_ney([t.encode() for _, t, *_ in rows if t and zlib.crc32(t.encode()) & 1 == 1 - fold], perplexity.LONG) for fold in (0, 1)]
    expected = {}
    for i, t, *_ in rows:
        if t:
            model = models[zlib.crc32(t.encode()) & 1]
            grams = brute.byte_grams(t.encode(), perplexity.LONG)
            expected[i] = -sum(math.log(model(g)) for g in grams) / len(grams)
    assert len(texts) > 30
    for r in perplexity.judged(frame(rows)).collect():
        assert r.score == (None if r.doc_id not in expected else pytest.approx(expected[r.doc_id], abs=1e-3))


def test_capitals_other_scripts_and_word_order(frame):
    rng = random.Random(15)
    small = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    follow = {w: rng.sample(small, 2) for w in small}

    def text():
        w = rng.choice(small)
        return [w := rng.choice(follow[w]) for _ in range(150)]

    def mixed(word):
        return "".join(rng.choice("abcdefghijklmnop") for _ in word)

    forms = [("upper", str.upper), ("greek", lambda w: w.translate({97 + k: 0x3B1 + k for k in range(16)})), ("order", str)]
    rows, odd = [], set()
    for lang, form in forms:
        for _ in range(120):
            rows.append((len(rows), " ".join(map(form, text())), lang, "s"))
        for _ in range(10):
            own = text()
            own = rng.sample(own, len(own)) if lang == "order" else list(map(mixed, own))
            odd.add(len(rows))
            rows.append((len(rows), " ".join(map(form, own)), lang, "s"))
    kept = {r.doc_id: r.kept for r in perplexity.judged(frame(rows)).collect()}
    for lang, _ in forms:
        plain = [kept[i] for i, _, x, _ in rows if x == lang and i not in odd]
        junk = [kept[i] for i, _, x, _ in rows if x == lang and i in odd]
        assert sum(plain) >= 0.95 * len(plain) and sum(junk) <= 0.1 * len(junk), (lang, sum(plain), sum(junk))


# 8 quality


def test_quality_scores(spark, frame, odd_rows, no_rows, vocabulary):
    rng = random.Random(6)
    good = [(100 + i, ". ".join(" ".join(rng.choices(vocabulary, k=9)).capitalize() for _ in range(6)), "en", "s") for i in range(120)]
    bad = [(300 + i, " ".join(x.upper() + "!!$" for x in rng.choices(vocabulary, k=50)), "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i, *_ in good[:80] + bad[:40]] + [(None, 1), (5, None)], "doc_id bigint, label int")
    got = by_id(quality.classify(frame(good + bad + odd_rows), labels))
    assert all(got[i].score > 0.7 for i, *_ in good[80:]) and all(got[i].score < 0.3 for i, *_ in bad[40:])
    assert all(0 <= r.score <= 1 for r in got.values()) and {1, 2, 3, None} <= set(got)
    assert {r.score for r in quality.classify(frame(odd_rows), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_rows, labels).collect() == []


def test_isotonic():
    total, weight = np.array([0.0, 3, 1, 4, 4]), np.array([4.0, 4, 4, 4, 4])
    assert quality.isotonic(total, weight).tolist() == [0, 0.5, 0.5, 1, 1]


# 9 byte-level BPE


@pytest.fixture(scope="module")
def coders():
    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.sampled_from(["aab", "the ", "é日", "01 \n"]), st.integers(0, 300))
def test_ids_equal_the_library(coders, text, letters, n):
    own, library = coders
    text += "".join(random.Random(n).choice(letters) for _ in range(n))
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_long_pre_tokens(coders):
    own, library = coders
    for text in ("a" * 60000, "".join(random.Random(1).choices("abcdefgh", k=60000))):
        assert own.encode(text) == library.encode_ordinary(text)


def test_encode_and_decode_tables(frame, odd_rows, no_rows):
    coded = bpe.encode(frame(odd_rows), TOKENIZER, public_tokenizers.PATTERN, decoded=True)
    source = {i: (t or "").encode() for i, t, *_ in odd_rows}
    assert all(bytes(r.decoded) == source[r.doc_id] for r in coded.collect())
    again = bpe.decode(coded, TOKENIZER, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == source[r.doc_id] for r in again.collect())
    assert bpe.encode(no_rows, TOKENIZER, public_tokenizers.PATTERN).collect() == []


# 10 decontamination


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=5, max_size=60))
def test_winnowing_keeps_one_of_every_window(values):
    h = np.array(values, np.uint64)
    kept = set(decontaminate.winnow(h, 5).tolist())
    for i in range(len(values) - 4):
        window = values[i : i + 5]
        assert i + max(j for j, v in enumerate(window) if v == min(window)) in kept


def test_contamination(spark, frame, odd_rows, no_rows, vocabulary):
    rng = random.Random(7)
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, text(n)) for i, n in enumerate([40, 25, 10, 10, 9, 4, 1])] + [(7, []), (8, None)]
    items += [(9, items[0][1][5:30]), (9, items[0][1][5:30])]
    rows = list(odd_rows)
    for i in range(60):
        w = text(50)
        _, own = items[i % 7]
        if i % 3:
            a = rng.randint(0, max(0, len(own) - 12))
            w[20:20] = own[a : a + rng.choice([9, 10, 11, 30])]
        rows.append((100 + i, " ".join(w).upper() if i % 2 else ", ".join(w), "en", "s"))
    bench = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in items], "item_id bigint, text string").withColumn("fp", decontaminate.F.lit(1))
    got = decontaminate.contamination(frame(rows), bench).collect()
    assert len(got) == len(rows)
    expected = brute.contamination({i: t for i, t, *_ in rows}, [(i, None if w is None else " ".join(w)) for i, w in items])
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r.item_ids))) == expected[r.doc_id]
    left = {r.doc_id for r in decontaminate.clean(frame(rows), bench).collect()}
    assert left == {i for i, x in expected.items() if not x[1]}
    assert decontaminate.contamination(no_rows, bench).collect() == []
    assert decontaminate.clean(frame(rows), bench.filter("item_id < 0")).count() == len(rows)


def test_word_hashes_are_those_of_the_words():
    texts = [b"ab ba  ab", b"", b" aabb abab ", "é É".encode()]
    h, off = words.word_hashes(texts, words.SPACED)
    tokens = [w for t in texts for w in t.lower().split()]
    assert off.tolist() == [0, 3, 3, 5, 7] and len(h) == len(tokens)
    assert len(set(zip(tokens, h.tolist(), strict=True))) == len(set(tokens)) == len(set(h.tolist()))
