"""Column helpers over file text: lines, tokens, matches with line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# line breaks other than \n alone, and all of them
RARE_BREAK = r"[\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029]"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029]"


def record(**fields: Column) -> Column:
    """Struct with the given field names (kept through every rewrite of nested lambdas)."""
    return F.named_struct(*[x for n, c in fields.items() for x in (F.lit(n), c)])


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, null when there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix of the last path part, dot included, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def each(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """One row per element of a computed list, none for an empty or null list.

    The outer form with a null test is on purpose: for the inner form the
    optimizer adds a size filter that would compute the list a second time.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def each_with_position(df: DataFrame, keep: list[str], items: Column, position: str, name: str) -> DataFrame:
    """``each`` with the 0-based position of the element."""
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).filter(F.col(name).isNotNull())


def split_lines(content: Column) -> Column:
    """Lines of a text; the costly pattern only runs on texts with rare line breaks."""
    return F.when(F.rlike(content, F.lit(RARE_BREAK)), F.split(content, LINE_BREAK)).otherwise(F.split(content, "\n"))


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line: ``line`` (1-based) and trimmed ``line_text``; ``content`` is dropped."""
    keep = [c for c in files.columns if c != content]
    exploded = each_with_position(files, keep, split_lines(F.col(content)), "_pos", "_raw")
    return exploded.select(*keep, (F.col("_pos") + 1).alias("line"), strip(F.col("_raw")).alias("line_text"))


def newlines(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))


# Unicode noncharacters: never part of interchanged text
START_MARK, NEXT_MARK, END_MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def without_marks(content: Column) -> Column:
    """Text in which the marks cannot occur; to be taken once before the match functions."""
    for mark in (START_MARK, NEXT_MARK, END_MARK):
        content = F.replace(content, F.lit(mark), F.lit(""))
    return content


def _marked(content: Column, pattern: str, groups: list[int]) -> Column:
    """Pieces of a text (without marks) cut at every match, from a single pass of the pattern.

    The first piece is the text before the first match; every further piece
    holds the groups, the match and the text up to the next match.
    """
    shown = "".join(f"${g}{NEXT_MARK}" for g in groups)
    return F.split(F.regexp_replace(content, pattern, f"{START_MARK}{shown}$0{END_MARK}"), START_MARK)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of all elements up to each one, by doubling steps: n log n additions and no growing copies."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))

    def add(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    return F.aggregate(rounds, numbers, add)


def occurrences(content: Column, pattern: str, **groups: int) -> Column:
    """All matches as array<struct<line, group columns...>>, also matches that span lines.

    ``line`` is one plus the line breaks in all text before the match.
    """
    pieces = _marked(content, pattern, list(groups.values()))

    def cut(piece: Column) -> Column:
        fields = F.split(F.substring_index(piece, END_MARK, 1), NEXT_MARK)
        return record(
            fields=fields,
            # line breaks of the match itself and of the text behind it
            breaks=newlines(F.get(fields, F.lit(len(groups)))) + newlines(F.substring_index(piece, END_MARK, -1)),
        )

    def found(pieces: Column) -> Column:
        cuts = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), cut)
        return let(record(cuts=cuts, first=F.lit(1) + newlines(F.get(pieces, F.lit(0)))), placed)

    def placed(x: Column) -> Column:
        return let(
            running_sums(F.transform(x["cuts"], lambda c: c["breaks"])),
            lambda sums: F.transform(
                x["cuts"],
                lambda c, i: record(
                    line=x["first"] + F.get(sums, i) - c["breaks"], **{g: F.get(c["fields"], F.lit(k)) for k, g in enumerate(groups)}
                ),
            ),
        )

    return let(pieces, found)


def match_lines(content: Column, pattern: str) -> Column:
    """Start line of every match in a text."""
    return F.transform(occurrences(content, pattern, found=0), lambda m: m["line"])


def text_lines(content: Column) -> Column:
    """Lines as counted by ``match_lines``."""
    return F.split(content, "\n")


def line_at(all_lines: Column, line: Column) -> Column:
    """Trimmed text of one line, '' when out of range."""
    return F.coalesce(strip(F.get(all_lines, line - 1)), F.lit(""))


def blank_out(content: Column, pattern: str, keep_group: int = 1) -> Column:
    """Text with all matches replaced by their line breaks, so line numbers stay.

    Matches where ``keep_group`` took part stay as they are.
    """
    pieces = _marked(content, pattern, [keep_group])

    def rest(piece: Column) -> Column:
        kept = F.substring_index(piece, NEXT_MARK, 1)
        match = F.substring_index(F.substring_index(piece, END_MARK, 1), NEXT_MARK, -1)
        return F.concat(
            F.when(kept != "", kept).otherwise(F.repeat(F.lit("\n"), newlines(match))), F.substring_index(piece, END_MARK, -1)
        )

    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(rest(p))), "")
