"""Operators that compare documents or lines with each other, and the pipeline."""

import os
import random

import brute
import pytest
from brute import SMALL

from cipherledger.llm import components, copies, line_dedup, near_dedup
from cipherledger.llm import rows as llm_rows


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    f = brute.Forest({x for e in edges for x in e})
    for a, b in edges:
        f.join(a, b)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: f.root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _edited(rng, words, vocabulary, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


@pytest.fixture(scope="module")
def families(odd_rows, vocabulary):
    """Copies, near copies in chains and in one large group, and texts that only share a passage."""
    rng = random.Random(11)
    rows, base = list(odd_rows), rng.choices(vocabulary, k=150)
    rows += [(1000 + i, " ".join(_edited(rng, base, vocabulary, 1 + i % 3)), "en", "s") for i in range(70)]
    rows += [(2000 + i, " ".join(base), "en", "s") for i in range(20)]
    link = rng.choices(vocabulary, k=200)
    for i in range(12):  # a chain: neighbours are near, ends are not
        link = _edited(rng, link, vocabulary, 2)
        rows.append((3000 + i, " ".join(link), "en", "s"))
    passage = rng.choices(vocabulary, k=60)
    rows += [(4000 + i, " ".join(passage + rng.choices(vocabulary, k=10 + i)), "en", "s") for i in range(40)]
    return rows + [(5000, "a b c", "en", "s"), (5001, "A  b c", "en", "s"), (5002, "a b", "en", "s")]


def test_only_near_copies_of_a_bucket_are_paired(spark):
    rng = random.Random(21)
    shared = [rng.getrandbits(63) for _ in range(150)]
    sets = {i: shared + [rng.getrandbits(63) for _ in range(150)] for i in range(120)}  # alike, but no copies
    for i in range(30):  # 300 of 334 and 300 of 300 + 75 shared: just inside
        sets[200 + i] = sets[i] + [rng.getrandbits(63) for _ in range(1 + i * 74 // 29)]
    table = spark.createDataFrame([(i, s) for i, s in sets.items()], "text_hash bigint, set array<bigint>")
    members = spark.createDataFrame([(7, i, i, len(s)) for i, s in sets.items()], "bucket bigint, text_hash bigint, label bigint, size int")
    got = [tuple(r) for r in copies._across(members, table, 80).collect()]
    assert set(got) >= {(i, 200 + i) for i in range(30)} and len(got) == len(set(got)) <= 40
    assert {tuple(r) for r in copies._alike(copies._across(members, table, 80), table, 80).collect()} == {(i, 200 + i) for i in range(30)}


def test_near_groups(frame, families, no_rows):
    expected = brute.near_groups({i: t for i, t, *_ in families if i is not None})
    got = near_dedup.classes(frame(families)).collect()
    assert len(got) == len(families)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None and r.kept
    left = [r.doc_id for r in near_dedup.unique(frame(families)).collect()]
    assert sorted(left, key=str) == sorted({x for _, x in expected.values()} | {None}, key=str)
    assert near_dedup.classes(no_rows).collect() == []
    assert near_dedup.unique(no_rows).count() == 0


def test_near_groups_at_a_lower_similarity(frame, vocabulary):
    rng = random.Random(31)
    rows = []
    for i in range(60):  # pairs around 0.8 and 0.85
        base = rng.choices(vocabulary, k=100 + i)
        rows += [(10 * i, " ".join(base), "en", "s"), (10 * i + 1, " ".join(base[: 4 * i % 7 + 88] + rng.choices(vocabulary, k=4 + i // 4)), "en", "s")]
        rows.append((10 * i + 2, " ".join(base[: len(base) - i % 25]), "en", "s"))
    texts = {i: t for i, t, *_ in rows}
    leaders = {x: {c for _, c in brute.near_groups(texts, x).values()} for x in (80, 85)}
    assert len(leaders[80]) < len(leaders[85])
    for x, ids in leaders.items():
        assert {r.doc_id for r in near_dedup.unique(frame(rows), x).collect()} == ids
    assert (near_dedup.least(85), near_dedup.least(80)) == (101, 91)


@pytest.fixture(scope="module")
def lined(odd_rows, vocabulary):
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    plate, other = line(8), line(9)

    def touch(text, n):
        out = list(text)
        for _ in range(n):
            i = rng.randrange(len(out))
            if rng.random() < 0.4:
                out[i] = rng.choice("xyzé")
            elif rng.random() < 0.5:
                out.insert(i, "q")
            else:
                del out[i]
        return "".join(out)

    rows = list(odd_rows)
    for i in range(40):
        own = [line(rng.randint(1, 12)) for _ in range(5)]
        own.insert(2, touch(plate, i % 3))
        if i % 4 == 0:
            own += ["", touch(own[0] + " and more words", 1), own[0] + " and more words", "end", "end"]
        if i % 5 == 0:
            own.append(other)
        rows.append((100 + i, "\n".join(own), "en", "s"))
    copy = "\n".join(line(10) for _ in range(6))
    return rows + [(300 + i, copy + ("" if i else "!"), "en", "s") for i in range(12)]


def test_lines(frame, lined, no_rows):
    classes, near = brute.line_classes([x for _, t, *_ in lined for x in (t or "").split("\n") if len(x) < 1000])
    got = {r.doc_id: r for r in line_dedup.removed(frame(lined)).collect()}
    left = {r.doc_id: r for r in line_dedup.cleaned(frame(lined)).collect()}
    first = {}
    for i, text, *_ in sorted((r for r in lined if r[0] is not None), key=lambda r: r[0]):
        lines = (text or "").split("\n")
        seen, repeats = set(), set()
        for k, x in enumerate(lines):
            if x.strip():
                c = classes.get(x, x)
                if c in seen:
                    repeats.add(k)
                first.setdefault(c, i)
                seen.add(c)
        gone = {int(k) for k in got[i].removed.split(",")} if got[i].removed else set()
        assert (got[i].n_lines, got[i].n_near, got[i].n_repeated) == (len(lines), sum(x in near for x in lines), len(repeats))
        assert repeats <= gone
        assert all(len(lines[k]) >= 20 and first[classes.get(lines[k], lines[k])] < i for k in gone - repeats)
        assert left[i].text == (text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert sum(r.n_boilerplate for r in got.values()) >= 39 and all(got[300 + i].n_boilerplate == 0 for i in range(12))
    assert line_dedup.removed(no_rows).collect() == [] and line_dedup.cleaned(no_rows).count() == 0


def test_boilerplate_counts_different_texts(frame, vocabulary, no_rows):
    rng = random.Random(21)
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    own = lambda n=4: [line(12) for _ in range(n)]
    head, foot, skewed, often, rare = line(9), line(9), line(9), line(9), line(9)
    texts = [[*own(), head, foot] for _ in range(30)]  # two lines together
    texts += [[*own(), head, "the end", foot] for _ in range(30)]
    group = own(30)
    texts += [[*group, skewed] for _ in range(200)]  # one large group of copies and near copies
    for i in range(60):
        near = list(group)
        near[i % 30] = f"{near[i % 30]} {line(1 + i % 2)}"
        texts.append([*near, skewed])
    texts += [[*own(), skewed] for _ in range(12)]
    texts += [[*own(), *[often] * 500]] + [[*own(), often] for _ in range(20)]
    texts += [[*own(), rare] for _ in range(2)]
    rows = [(i, "\n".join(x), "en", "s") for i, x in enumerate(texts)]
    classes, _ = brute.line_classes({x for t in texts for x in t})
    same = brute.near_groups({i: t for i, t, *_ in rows}, 80)
    holders = {}
    for i, t in enumerate(texts):
        for x in t:
            if len(x) >= 20:
                holders.setdefault(classes[x], set()).add(i)
    plates = {c for c, ids in holders.items() if len({same[i][1] for i in ids}) >= 3}
    assert {classes[x] for x in (head, foot, skewed, often)} <= plates and classes[rare] not in plates
    assert not {classes[x] for x in group} & plates
    for r in line_dedup.removed(frame(rows)).collect():
        t, gone, seen = texts[r.doc_id], set(), set()
        for k, x in enumerate(t):
            c = classes[x]
            if c in seen or (c in plates and min(holders[c]) < r.doc_id):
                gone.add(k)
            seen.add(c)
        assert r.removed == ",".join(map(str, sorted(gone)))


def test_near_copies_of_all_sizes(frame, vocabulary):
    """Links are those of brute force for sets that fill all cells and for sets that fill a few, and no table of keys is left."""
    from cipherledger import session

    rng = random.Random(34)
    texts = []
    for n in (5, 7, 12, 40, 150, 600):
        for _ in range(12):
            words = rng.choices(vocabulary, k=n)
            texts.append(" ".join(words))
            if n >= 12:
                at = rng.randrange(n - 1)
                texts += [" ".join(words + ["end"]), " ".join(words[:at] + ["other"] + words[at + 1 :])]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs, start = frame(rows).withColumn("text_hash", llm_rows.text_hash()), session.written_so_far()
    named = {r.text_hash: r.copy for r in copies.near_copies(docs, docs.select("text_hash").distinct(), 80).collect()}
    mine = {r.doc_id: named.get(r.text_hash, r.text_hash) for r in docs.select("doc_id", "text_hash").collect()}
    groups = {}
    for i, (_, c) in brute.near_groups({i: t for i, t, *_ in rows}, 80).items():
        groups.setdefault(c, set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i in mine if mine[i] == c) for c in set(mine.values())}
    assert not any(p.rsplit("/", 1)[-1].startswith(("bits-", "bands-", "buckets-", "met-")) for p in session._WRITTEN[start:])


def test_banded_distance(spark):
    rng = random.Random(13)
    pairs = []
    while len(pairs) < 400:
        a = "".join(rng.choice("abé") for _ in range(rng.randint(6, 18)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        b = "".join(b)
        if abs(len(a) - len(b)) <= 2 and len(b) > 2:
            pairs.append((a, b, brute.distance(a, b) <= 2))
    df = spark.createDataFrame(pairs, "x string, y string, near boolean")
    assert df.filter(line_dedup.edit_distance_within("x", "y") != df.near).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not present")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from cipherledger.session import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SMALL), name)
        kept[name] = rows = docs.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= set(before) and len(rows) == len(ids)
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert len(ids) >= 0.98 * len(before)
        if name == "near_dedup":
            assert ids == {c for _, c in brute.near_groups(before, 80).values()}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert ids == {i for i, x in brute.contamination(before, items).items() if not x[1]}
        if name == "byte_bpe":
            assert all(r.decoded_sha256 == brute.sha(before[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)
    assert corpus_pipeline.run(spark, SMALL).count() == len(kept["byte_bpe"])


def test_pipeline_of_no_rows_and_odd_rows(spark, frame, odd_rows, no_rows):
    import corpus_pipeline
    from cipherledger.session import written

    for docs in (no_rows, frame(odd_rows)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), name)
    assert {r.doc_id for r in docs.collect()} <= {i for i, *_ in odd_rows}
