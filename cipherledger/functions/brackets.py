"""Bracket structure of source text, from running sums of depth.

A text is read once by a pattern of tokens: strings, brackets with what stands in front of
them, and keys. Running sums over the tokens give byte offsets, lines and depths; sorted
by depth, an opening bracket is followed by its partner, so every group is found in
n log n steps however deep it lies. Offsets are bytes: a slice of bytes costs its length
only, while characters of a string would be counted from its start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherledger.functions.text import END_MARK, NEXT_MARK, START_MARK, let, newlines, record

STRING = r"\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'"


def _rounds(array: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(array), F.lit(1)))).cast("int"))


def _step(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _sums(tokens: Column, *names: str) -> Column:
    """Running sums of several integer fields in one pass of doubling steps."""
    start = F.transform(tokens, lambda t: record(**{n: t[n] for n in names}))

    def add(sums: Column, k: Column) -> Column:
        def plus(x: Column, i: Column) -> Column:
            back = F.get(sums, i - _step(k))
            return record(**{n: x[n] + F.coalesce(back[n], F.lit(0)) for n in names})

        return F.transform(sums, plus)

    return F.aggregate(_rounds(tokens), start, add)


def _next(flags: Column) -> Column:
    """For each position the first position from it on with a true flag, by doubling steps."""
    start = F.transform(flags, lambda f, i: F.when(f, i))
    return F.aggregate(_rounds(flags), start, lambda at, k: F.transform(at, lambda x, i: F.coalesce(x, F.get(at, i + _step(k)))))


def text_between(raw: Column, start: Column, end: Column) -> Column:
    """Text of a byte range [start, end) of binary ``raw``."""
    return F.substring(raw, start + 1, F.greatest(end - start, F.lit(0))).cast("string")


def _pieces(text: Column, pattern: str, fields: list[str]) -> Column:
    """Text cut before every match; a piece holds the fields, the match and what follows it."""
    shown = "".join(f + NEXT_MARK for f in fields)
    return F.split(F.regexp_replace(text, pattern, f"{START_MARK}{shown}$0{END_MARK}"), START_MARK)


def tokens(text: Column, pattern: str, fields: dict[str, str], opens: str, closes: str) -> Column:
    """Matches as array<struct<depth, i, fields..., delta, start, stop, line, after>>, sorted by depth and place.

    ``fields`` names replacement references of the pattern; ``opens`` and ``closes`` are the
    references that take part in matches of opening and closing brackets. A bracket has the
    depth of its group, other tokens the depth of groups beside them. ``after`` is the text
    up to the next match. The text must not contain the marks.
    """
    names = list(fields)

    def token(piece: Column) -> Column:
        parts = F.split(F.substring_index(piece, END_MARK, 1), NEXT_MARK)
        after, match = F.substring_index(piece, END_MARK, -1), F.get(parts, F.lit(len(names) + 2))
        delta = F.when(F.get(parts, F.lit(len(names))) != "", 1).when(F.get(parts, F.lit(len(names) + 1)) != "", -1).otherwise(0)
        return record(
            **{n: F.get(parts, F.lit(k)) for k, n in enumerate(names)}, delta=delta, after=after, size=F.octet_length(match),
            bytes=F.octet_length(match) + F.octet_length(after), breaks=newlines(match) + newlines(after),
        )

    def placed(x: Column) -> Column:
        def place(t: Column, i: Column, s: Column) -> Column:
            start = x["head"] + s["bytes"] - t["bytes"]
            return record(
                depth=s["delta"] + F.when(t["delta"] > 0, 0).otherwise(1), i=i, **{n: t[n] for n in names}, delta=t["delta"], start=start,
                stop=start + t["size"], line=x["line"] + s["breaks"] - t["breaks"], after=t["after"], last=i == F.size(x["all"]) - 1,
            )

        found = let(_sums(x["all"], "bytes", "breaks", "delta"), lambda sums: F.transform(x["all"], lambda t, i: place(t, i, F.get(sums, i))))
        return F.array_sort(found)

    def found(pieces: Column) -> Column:
        head = F.get(pieces, F.lit(0))
        rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), token)
        return let(record(all=rest, head=F.octet_length(head), line=F.lit(1) + newlines(head)), placed)

    return let(_pieces(text, pattern, [*fields.values(), opens, closes]), found)


def value_ends(sorted_tokens: Column) -> Column:
    """For each token the byte where a value that starts behind it ends: a comma, line break or closing bracket beside it."""
    stops = r"[,\n]"

    def ends(t: Column, k: Column) -> Column:
        ahead = F.get(sorted_tokens, k + 1)
        goes_on = (ahead["depth"] == t["depth"]) & ((t["delta"] > 0) | (ahead["i"] == t["i"] + 1)) & ~F.rlike(t["after"], F.lit(stops))
        return ~F.coalesce(goes_on | (t["delta"] > 0), F.lit(False))

    def end(k: Column) -> Column:
        t = F.get(sorted_tokens, k)
        return t["stop"] + F.octet_length(F.regexp_extract(t["after"], r"^[^,\n]*", 0))

    return let(_next(F.transform(sorted_tokens, ends)), lambda at: F.transform(at, end))


_SPLIT = rf"{STRING}|([(\[{{])|([)\]}}])|(,)"


def split_top_level(text: Column) -> Column:
    """Parts of a text between the commas outside of strings and brackets."""
    plain = F.split(text, ",")

    def token(piece: Column) -> Column:
        parts = F.split(F.substring_index(piece, END_MARK, 1), NEXT_MARK)
        delta = F.when(F.get(parts, F.lit(0)) != "", 1).when(F.get(parts, F.lit(1)) != "", -1).otherwise(0)
        return record(delta=delta, comma=F.get(parts, F.lit(2)) != "", rest=F.concat(F.get(parts, F.lit(3)), F.substring_index(piece, END_MARK, -1)))

    def cut(x: Column) -> Column:
        def shown(t: Column, i: Column, s: Column) -> Column:
            return F.when(t["comma"] & (s["delta"] == 0), F.concat(F.lit(START_MARK), F.substring(t["rest"], F.lit(2), F.length(t["rest"])))).otherwise(t["rest"])

        whole = let(_sums(x["all"], "delta"), lambda sums: F.array_join(F.transform(x["all"], lambda t, i: shown(t, i, F.get(sums, i))), ""))
        return F.split(F.concat(x["head"], whole), START_MARK)

    def nested(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), token)
        return let(record(head=F.get(pieces, F.lit(0)), all=rest), cut)

    return F.when(F.rlike(text, F.lit("[()\\[\\]{}\"']")), let(_pieces(text, _SPLIT, ["$1", "$2", "$3"]), nested)).otherwise(plain)
