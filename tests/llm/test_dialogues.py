import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cipherledger.llm import dialogues, queries

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}  # by last initial


def best(rows):
    """Least (cost, audit, repaired lines) of rows (role, text, must_delete, truncated), by recursion from the end."""
    rest = {}

    def leg(last, role):
        return (role in "su" if last == "" else role == NEXT[last]) if role in ("s", "u", "a") else False

    for i in range(len(rows), -1, -1):
        here = {}
        for last in ("", "s", "u", "a"):
            options = []
            if i == len(rows):
                if last in ("", "a"):
                    options.append((0, "", ()))
            else:
                role, text, must, cut = rows[i]
                cost, audit, lines = rest[i + 1, last]
                options.append((cost + 3, "D" + audit, lines))
                if not must:
                    if leg(last, role[:1]):
                        cost, audit, lines = rest[i + 1, role[:1]]
                        options.append((cost + cut, "K" + audit, (f"{role}:{text}", *lines)))
                    new = NEXT[last]
                    cost, audit, lines = rest[i + 1, new]
                    options.append((cost + 2 + cut, "R" + audit, (f"{'user' if new == 'u' else 'assistant'}:{text}", *lines)))
            here[last] = min(options, default=(10**9, "", ()))
        for _ in range(3):
            for last in ("", "s", "u", "a"):
                new = NEXT[last]
                cost, audit, lines = here[new]
                here[last] = min(here[last], (cost + 2, "I" + audit, ("user:" if new == "u" else "assistant:", *lines)))
        for last, option in here.items():
            rest[i, last] = option
    return rest[0, ""]


def expected(turns, ids):
    """Rows by conversation; turns: (conv_id, turn, role, text)."""
    by = {i: [] for i in ids}
    for conv, turn, role, text in turns:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role, text, fault in (0, 1), int(fault == 2)))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        numbers = {r[0] for r in rows if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, lines = best(marked)
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def table(spark, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, row int, code string, digest string, part int, block int, audit string, head string"
    return spark.createDataFrame([(*r, 1, "c", "d", 2, 3, "a", "h") for r in rows], schema).repartition(5)


def invented(seed, n, length, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Fine.", "Yes!", "no end", "Why? ", "", " \t\n", None, "x.\n", "other words here.", "Ünïcödé 日本."]
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(0, length)):
            turn += rng.choice([0, 1, 1, 1, 2, 5])
            text = rng.choice(texts) if rng.random() < 0.5 else f"line {rng.random()}."
            out.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(roles), text))
    return out


def test_repair_equals_brute_force(spark):
    rows = invented(1, 150, 12) + [(None, 1, "user", "a."), (None, 2, "assistant", "b.")] + [(999, None, "user", "z."), (999, None, "user", "z.")]
    got = rows_of(dialogues.repair(table(spark, rows)))
    assert got == expected(rows, {r[0] for r in rows})


@pytest.mark.parametrize("block", [1, 3, 7])
def test_long_conversations_in_fragments(spark, monkeypatch, block):
    monkeypatch.setattr(dialogues, "BLOCK", block)
    monkeypatch.setattr(dialogues, "SLICE", 16)
    rows = invented(block, 6, 90) + invented(9, 1, 1) + [(77, 3, "user", "the very same turn.")] * 40
    got = rows_of(dialogues.repair(table(spark, rows)))
    assert got == expected(rows, {r[0] for r in rows})


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    source = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(queries.QUERIES["op12_dialogue_repair"](spark, folder))
    assert got == expected(damage(source), {r[0] for r in source})


def test_damage_and_lost_conversations(spark):
    rows = invented(4, 60, 6)
    frame = table(spark, rows)
    harmed = queries.damaged(frame)
    assert sorted(map(str, map(tuple, harmed.collect()))) == sorted(map(str, damage(rows)))
    got = rows_of(dialogues.repair(harmed, frame))
    assert got == expected(damage(rows), {r[0] for r in rows})
    lost = [r for r in got if not any(d[0] == r[0] for d in damage(rows))]
    assert lost and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in lost)


def test_repaired_turns(spark):
    rows = invented(5, 40, 10)
    frame = table(spark, rows)
    audits = dialogues.audited(frame, frame)
    lines = {}
    for r in dialogues.repaired(audits, frame).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {r[0]: r[-1] for r in expected(rows, {r[0] for r in rows})}
    for conv, sha in want.items():
        mine = lines.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in mine))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mine).encode()).hexdigest() == sha


def test_ranks_of_a_long_fragment():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 16, 3000).astype(np.uint8)
    cost, leave, audits = dialogues.least_paths([codes], np.array([dialogues.ENDS]))
    roles = ["system", "user", "assistant", "tool"]
    plain = best([(roles[c // 4], "t", c % 4 in (1, 2), int(c % 4 == 3)) for c in codes.tolist()])
    assert (int(cost[0, 0]), audits[0][0] + dialogues.TAIL[leave[0, 0]]) == plain[:2]
    whole = dialogues.matrix([codes])[0] + np.array(dialogues.ENDS)
    assert whole.min(axis=1).tolist() == cost[0].tolist()


def test_no_conversations(spark):
    none = table(spark, [(1, 1, "user", "a.")]).filter("conv_id > 1")
    out = dialogues.repair(none)
    assert out.columns == COLUMNS and out.count() == 0
