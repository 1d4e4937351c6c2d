"""Structure repair of conversations: the cheapest edits that give ``(s?(ua)+)?`` role initials.

A turn may be kept, given another role or deleted, and an empty turn may be inserted
anywhere. What a prefix of the result looks like is one of four states, so costs are
(min, +) products of 4 x 4 matrices. The audit (edit initials in order) must be the
ASCII-least of the cheapest ones.

1. *Fragments.* Turns are narrowed to one byte (role class and fault), dealt by range of
   (conv_id, turn, role, text digest) and cut into fragments of BLOCK turns at most, so a
   long conversation is spread over tasks. A fragment's matrix comes with it.
2. *Costs.* From the last fragment of a conversation to its first, matrices give the cost
   to go at each fragment's end; only conversations of several fragments take this step.
3. *Ranking.* Within a fragment the arcs that keep the least cost to go are known. Nodes
   (turn, state) are ranked by the first audit letter, then by the first 2, 4, 8, ...
   letters: the rank of 2k letters is that of the pair (rank of k letters here, rank of
   k letters where the pointer over k letters leads), and the pointers double with it.
   Ranks choose the arc; the pointers mark the least path and say how far each of its
   nodes is from the end. This is done for each state in which a fragment can be entered.
4. *Path.* From the first fragment to the last, the state at the end of one is the entry
   of the next; audits are joined in this order.
5. *Texts.* Turns stream by conversation through their edits. What is in memory is the
   audit, which is a value of the result anyway. A digest of a whole conversation can't
   be split: its turns are read in order by one task, and never held together.

Defined results: a null role or text is one space; turns stand by turn number (nulls
first), role, and md5 of the text; equal turns are interchangeable; a role that begins
with s, u or a counts as system, user or assistant; a null conv_id is a conversation of
its own; a conversation without turns needs no edits; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.session import written

BLANKS = "\t\n\x0b\x0c\r "
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)  # faults
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # role classes
START, AFTER_S, AFTER_U, AFTER_A = range(4)  # states; START and AFTER_A may end
LETTERS = np.frombuffer(b"DIKR", np.uint8)  # in ASCII order
FAR = 1 << 40  # more than any cost
BLOCK = 1 << 12  # turns in a fragment
SLICE = 1 << 16  # turns that a task ranks at once

# where a turn of a class leads from a state (-1: not allowed), where a user or assistant turn leads
KEEPS = np.array([[AFTER_S, -1, -1, -1], [AFTER_U, AFTER_U, -1, AFTER_U], [-1, -1, AFTER_A, -1], [-1, -1, -1, -1]])
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
TAIL = ["", "II", "I", ""]  # inserts that end a conversation in each state
ENDS = [0, 4, 2, 0]  # and their costs
LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Costs (code, state, letter) and end states (state, letter by code) of the letters D, K, R of a turn."""
    cost, to = np.full((16, 4, 4), FAR, np.int64), np.zeros((16, 4, 4), np.int64)
    for code in range(16):
        kind, fault = divmod(code, 4)
        for state in range(4):
            cost[code, state, 0], to[code, state, 0] = 3, state
            if fault in (NONE, TRUNCATED):
                mark = int(fault == TRUNCATED)
                if KEEPS[kind, state] >= 0:
                    cost[code, state, 2], to[code, state, 2] = mark, KEEPS[kind, state]
                cost[code, state, 3], to[code, state, 3] = 2 + mark, NEXT[state]
    return cost, to


COST, TO = _arcs()


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Costs to go (..., state) if turns may be inserted first."""
    out = cost.copy()
    out[..., AFTER_U] = np.minimum(cost[..., AFTER_U], 2 + cost[..., AFTER_A])
    out[..., AFTER_A] = np.minimum(cost[..., AFTER_A], 2 + cost[..., AFTER_U])
    for s in (START, AFTER_S):
        out[..., s] = np.minimum(cost[..., s], 2 + out[..., AFTER_U])
    return out


# ---------------------------------------------------------------- fragments


def narrow(turns: DataFrame) -> DataFrame:
    """conv_id, turn and code (role class and first fault) of every turn, with the columns that order them."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    end = F.rtrim(text, F.lit(BLANKS))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.md5(text).alias("digest"), (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "turns")
    # the first of equal turns; a hot text is combined where it is read
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("first"))
    seen = rows.join(firsts.select(F.col("first.row").alias("row"), F.lit(True).alias("is_first")), "row", "left")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(NONE)
    return written(seen.select("conv_id", "turn", "role", "digest", "row", (kind * 4 + fault).cast("int").alias("code")), "codes")


def matrix(codes: list[np.ndarray]) -> np.ndarray:
    """(fragment, from, to): least costs over each fragment, with inserts before its turns."""
    sizes = np.array([len(c) for c in codes])
    out = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(codes), 0).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    for t in range(int(sizes.max(initial=0))):  # the t-th turn from the end
        at = order[: int((sizes > t).sum())]
        code = np.array([codes[f][-1 - t] for f in at])
        step = COST[code][..., [0, 2, 3], None] + out[at][np.arange(len(at))[:, None, None], TO[code][..., [0, 2, 3]]]
        best = step.min(axis=2)  # (fragment, from, to) after a D, K or R
        out[at] = with_inserts(best.transpose(0, 2, 1)).transpose(0, 2, 1)
    return np.minimum(out, FAR)


def fragments(codes: DataFrame) -> DataFrame:
    """conv_id, part, block (its place), codes, counts of faults, matrix (16 costs)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    key = ["conv_id", "turn", "role", "digest", "row"]
    names = ["conv_id", "part", "block", "codes", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "matrix"]

    def rows(ready, part, first):
        ids, codes = [r[0] for r in ready], [r[1] for r in ready]
        faults = [np.bincount(c % 4, minlength=4) for c in codes]
        illegal = [int((~LEGAL[c[:-1] // 4, c[1:] // 4]).sum()) for c in codes]
        columns = [
            pa.concat_arrays(ids), pa.array([part] * len(ids), pa.int32()), pa.array(range(first, first + len(ids)), pa.int64()),
            pa.array([c.tobytes() for c in codes], pa.binary()), *(pa.array([int(f[k]) for f in faults], pa.int64()) for k in (BLANK, DUPLICATE, TRUNCATED)),
            pa.array(illegal, pa.int64()), pa.array(matrix(codes).reshape(-1, 16).tolist(), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        part, block, ready, size = TaskContext.get().partitionId(), 0, [], 0
        held, codes = None, np.zeros(0, np.uint8)  # conversation not yet ended: its id (array of one) and codes
        for batch in batches:
            ids, code = batch.column(0), batch.column(1).to_numpy().astype(np.uint8)
            if not len(ids):
                continue
            if held is not None:
                ids, code = pa.concat_arrays([held.take(pa.array(np.zeros(len(codes), np.int64))), ids]), np.concatenate([codes, code])
            a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
            change = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
            for low, high in zip(bounds[:-1], bounds[1:]):
                last = high == len(ids)
                while high - low > (BLOCK if last else 0):
                    n = min(BLOCK, high - low)
                    ready.append((ids.slice(low, 1), code[low : low + n]))
                    low, size = low + n, size + n
                    if size >= SLICE:
                        yield rows(ready, part, block)
                        block, ready, size = block + len(ready), [], 0
                if last:
                    held, codes = ids.slice(low, 1), code[low:high]
        if held is not None:
            ready.append((held, codes))
        if ready:
            yield rows(ready, part, block)

    longs = [T.StructField(n, T.LongType()) for n in names[4:8]]
    out = T.StructType([
        codes.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("codes", T.BinaryType()), *longs, T.StructField("matrix", T.ArrayType(T.LongType())),
    ])
    dealt = codes.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "code")
    return written(dealt.mapInArrow(run, out), "fragments")


def _costs_to_go(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs to go at the end of each fragment of one conversation."""
    rows = rows.sort_values(["part", "block"], ascending=False)
    cost, out = np.array(ENDS, np.int64), []
    for m in rows["matrix"]:
        out.append(cost.tolist())
        cost = np.minimum(FAR, (np.array(m, np.int64).reshape(4, 4) + cost).min(axis=1))
    return pd.DataFrame({"part": rows["part"].to_numpy(), "block": rows["block"].to_numpy(), "ends": out})


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry state of each fragment of one conversation, whether it is the last, and an illegal pair at its front."""
    rows = rows.sort_values(["part", "block"])
    state, before, out = START, None, []
    for exits, first, last in zip(rows["exits"], rows["first_code"], rows["last_code"]):
        out.append((state, int(before is not None and not LEGAL[before // 4, first // 4])))
        state, before = int(exits[state]), last
    n = len(out)
    return pd.DataFrame({
        "part": rows["part"].to_numpy(), "block": rows["block"].to_numpy(), "entry": [s for s, _ in out],
        "crossing": [c for _, c in out], "is_last": [i == n - 1 for i in range(n)],
    })


# ---------------------------------------------------------------- ranking


def least_paths(codes: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Of fragments with costs to go ``ends`` (fragment, state): cost to go at the entry, exit state and audit for each entry state."""
    sizes = np.array([len(c) for c in codes])
    first = np.concatenate([[0], np.cumsum(4 * (sizes + 1))])  # node of turn i, state s of fragment f: first[f] + 4 * i + s
    n = int(first[-1])
    state = np.arange(4)
    exits = (first[:-1] + 4 * sizes)[:, None] + state
    go = np.zeros(n, np.int64)
    go[exits] = ends
    price, target = np.full((n, 4), FAR, np.int64), np.arange(n)[:, None].repeat(4, 1)  # of the arcs D, I, K, R
    order = np.argsort(-sizes, kind="stable")
    for t in range(int(sizes.max(initial=0))):
        at = order[: int((sizes > t).sum())]
        here = (first[at] + 4 * (sizes[at] - 1 - t))[:, None] + state
        code = np.array([codes[f][-1 - t] for f in at])
        to = (here[:, :1] + 4)[..., None] + TO[code]
        cost = COST[code] + go[to]
        go[here] = with_inserts(cost.min(axis=2))
        to[..., 1] = here[:, NEXT]
        cost[..., 1] = 2 + go[to[..., 1]]
        price[here], target[here] = cost, to
    inner = np.ones(n, bool)
    inner[exits] = False
    best = (price == go[:, None]) & inner[:, None]

    # ranks by 1, 2, 4, ... letters, with pointers over as many; an ended path has the rank 0 and stays
    arc = best.argmax(axis=1)  # letters at a node differ, so the first is the least
    rank, pointer, steps = np.where(inner, arc + 1, 0), np.where(inner, target[np.arange(n), arc], np.arange(n)), inner.astype(np.int64)
    pointers = [pointer]
    while inner[pointer].any():
        _, rank = np.unique(rank * (n + 1) + rank[pointer], return_inverse=True)
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
    # the arc with the least letter, then the least rank where it leads
    choice = np.where(best, np.arange(4) * (n + 1) + rank[target], FAR).argmin(axis=1)

    audits: list[list[str]] = [[] for _ in codes]
    leave = np.zeros((len(codes), 4), np.int64)
    for s in range(4):
        entry = first[:-1] + s
        on = np.zeros(n, bool)
        on[entry] = True
        for p in reversed(pointers):
            on[p[np.flatnonzero(on)]] = True
        leave[:, s] = pointer[entry] - exits[:, 0]
        path = np.flatnonzero(on & inner)
        of = np.searchsorted(first, path, "right") - 1
        length = steps[entry]
        at = np.concatenate([[0], np.cumsum(length)])
        text = np.zeros(int(at[-1]), np.uint8)
        text[at[of] + length[of] - steps[path]] = LETTERS[choice[path]]
        whole = text.tobytes().decode("ascii")
        for f in range(len(codes)):
            audits[f].append(whole[at[f] : at[f + 1]])
    return go[first[:-1][:, None] + state], leave, audits


def ranked(pieces: DataFrame) -> DataFrame:
    """Fragments (with ends) -> part, block, first_code, last_code, cost (from the start state), exits and audits by entry state."""
    import pyarrow as pa

    names = ["conv_id", "part", "block", "first_code", "last_code", "cost", "exits", "audits"]

    def run(batches):
        for batch in batches:
            codes = [np.frombuffer(c, np.uint8) for c in batch.column(3).to_pylist()]
            ends = np.array(batch.column(4).to_pylist(), np.int64).reshape(-1, 4)
            bounds = np.searchsorted(np.cumsum([len(c) for c in codes]), np.arange(SLICE, sum(map(len, codes)) + SLICE, SLICE), "right")
            for low, high in zip([0, *bounds[:-1].tolist()], bounds.tolist()):
                high = len(codes) if high == bounds[-1] else high
                if low == high:
                    continue
                some = codes[low:high]
                cost, leave, audits = least_paths(some, ends[low:high])
                columns = [
                    *(batch.column(k).slice(low, high - low) for k in range(3)), pa.array([int(c[0]) for c in some], pa.int32()),
                    pa.array([int(c[-1]) for c in some], pa.int32()), pa.array(cost[:, START]), pa.array(leave.tolist(), pa.list_(pa.int64())),
                    pa.array(audits, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = T.StructType([
        pieces.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("first_code", T.IntegerType()), T.StructField("last_code", T.IntegerType()), T.StructField("cost", T.LongType()),
        T.StructField("exits", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())),
    ])
    return pieces.select("conv_id", "part", "block", "codes", "ends").mapInArrow(run, out)


def audited(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each conv_id of ``conversations``."""
    codes = narrow(turns)
    parts = fragments(codes)
    several = parts.withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).filter("n > 1")
    place = "part int, block bigint"
    go = several.select("conv_id", "part", "block", "matrix").groupBy("conv_id").applyInPandas(_costs_to_go, f"{place}, ends array<bigint>")
    ends = F.coalesce("ends", F.array(*[F.lit(c).cast("long") for c in ENDS]))
    pieces = parts.join(go, ["part", "block"], "left").withColumn("ends", ends)
    paths = written(ranked(pieces), "paths")
    marks = several.select("part", "block").join(paths.select("conv_id", "part", "block", "exits", "first_code", "last_code"), ["part", "block"])
    entries = marks.groupBy("conv_id").applyInPandas(_entries, f"{place}, entry int, crossing int, is_last boolean")
    entry = F.coalesce("entry", F.lit(START))
    left = F.element_at("exits", entry + 1)
    tail = F.when(F.coalesce("is_last", F.lit(True)), F.element_at(F.array(*map(F.lit, TAIL)), (left + 1).cast("int"))).otherwise("")
    segments = paths.join(entries, ["part", "block"], "left").select(
        "conv_id", F.struct("part", "block", "cost", F.concat(F.element_at("audits", entry + 1), tail).alias("audit")).alias("segment"),
        F.coalesce("crossing", F.lit(0)).cast("long").alias("n_illegal"),
    )
    numbers = codes.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.when(F.count("turn") > 0, F.max("turn") - F.min("turn") + 1 - F.count("turn")).otherwise(0).cast("long").alias("gaps")
    )
    counts = parts.select("conv_id", "n_blank", "n_duplicate", "n_truncated", "n_illegal")
    every = conversations.select("conv_id").distinct()
    for part in (segments, numbers, counts):
        every = every.unionByName(part, allowMissingColumns=True)
    ordered = F.array_sort(F.collect_list("segment"))

    def total(name):
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    out = every.groupBy("conv_id").agg(
        total("gaps").alias("gaps"), *(total(f"n_{n}").alias(n) for n in ("blank", "duplicate", "truncated", "illegal")), ordered.alias("segments")
    )
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce(F.try_element_at("segments", F.lit(1))["cost"], F.lit(0).cast("long")).alias("cost"),
        F.array_join(F.transform("segments", lambda s: s.audit), "").alias("audit"),
    )


# ---------------------------------------------------------------- texts


def _edited(audit: str, turns):
    """Repaired (edit, role, text) of one conversation, turn by turn; None after a deletion."""
    state, at = START, 0

    def inserts():
        nonlocal state, at
        while audit[at : at + 1] == "I":
            state, at = int(NEXT[state]), at + 1
            yield "I", ("user" if state == AFTER_U else "assistant"), ""

    for role, text in turns:
        yield from inserts()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            state = int(NEXT[state])
            role = "user" if state == AFTER_U else "assistant"
        else:
            state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
        yield edit, role, text
    yield from inserts()


def _streamed(audits: DataFrame, turns: DataFrame) -> tuple[DataFrame, list[str]]:
    """Audit rows, each before the turns of its conversation in order; and the names of the audit's columns."""
    names = [c for c in audits.columns if c != "conv_id"]
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role, text, F.md5(F.coalesce(turns["text"].cast("string"), F.lit(" "))).alias("digest"), F.lit(True).alias("is_turn"))
    heads = audits.select("conv_id", F.struct(*names).alias("head"), F.lit(False).alias("is_turn"))
    both = heads.unionByName(rows, allowMissingColumns=True)
    order = ["conv_id", "is_turn", "turn", "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "head", "is_turn", "role", "text"), names


def _conversations(batches):
    """(conv_id as an array of one, head, iterator of turns) in stream order; the iterator must be used up before the next."""
    def flat():
        for batch in batches:
            heads, are, roles, texts = (batch.column(k).to_pylist() for k in range(1, 5))
            for i, is_turn in enumerate(are):
                yield is_turn, batch, i, heads[i], roles[i], texts[i]

    rows, ahead = flat(), None

    def turns():
        nonlocal ahead
        for row in rows:
            if not row[0]:
                ahead = row
                return
            yield row[4], row[5]
        ahead = None

    ahead = next(rows, None)
    while ahead is not None:
        _, batch, i, head, _, _ = ahead
        ahead, mine = None, turns()
        yield batch.column(0).slice(i, 1), head, mine


def digests(audits: DataFrame, turns: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256, the digest of the repaired ``role:text`` lines."""
    import pyarrow as pa

    stream, names = _streamed(audits, turns)

    def run(batches):
        ids, heads, shas = [], [], []

        def made():
            columns = [pa.concat_arrays(ids), *(pa.array([h[n] for h in heads], kinds[n]) for n in names), pa.array(shas)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *names, "repaired_sha256"])

        for conv, head, mine in _conversations(batches):
            sha, empty = hashlib.sha256(), True
            for _, role, text in _edited(head["audit"], mine):
                sha.update((("" if empty else "\n") + f"{role}:{text}").encode())
                empty = False
            ids.append(conv)
            heads.append(head)
            shas.append(sha.hexdigest())
            if len(ids) >= 1000:
                yield made()
                ids, heads, shas = [], [], []
        if ids:
            yield made()

    kinds = {n: pa.string() if audits.schema[n].dataType == T.StringType() else pa.int64() for n in names}
    out = T.StructType([audits.schema["conv_id"], *(audits.schema[n] for n in names), T.StructField("repaired_sha256", T.StringType())])
    return stream.mapInArrow(run, out)


def repaired(audits: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text of the repaired turns."""
    import pyarrow as pa

    stream, _ = _streamed(audits, turns)
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches):
        for conv, head, mine in _conversations(batches):
            edited, at = _edited(head["audit"], mine), 0
            while some := [row for _, row in zip(range(1000), edited)]:
                ids = conv.take(pa.array(np.zeros(len(some), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(at, at + len(some)), pa.int64()), *map(pa.array, zip(*some))], names)
                at += len(some)

    texts = [T.StructField(n, T.StringType()) for n in names[2:]]
    return stream.mapInArrow(run, T.StructType([turns.schema["conv_id"], T.StructField("position", T.LongType()), *texts]))


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation: faults, cost, audit and digest of the repaired turns."""
    audits = written(audited(turns, turns if conversations is None else conversations), "audits")
    return digests(audits, turns)
