"""Python source: statement facts by pattern, resolved against the imports of the file.

Comments and documentation strings are blanked out first.  Facts are taken
from whole files (calls and imports may span lines).  All facts of a file come
from its own row, so names resolve through a small map in that row and a scan
is one pass over the files without any shuffle.  ``resolve_facts`` is the same
resolution as an equality join, for fact tables that are already stored.
"""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cipherledger.functions import vocab
from cipherledger.functions.brackets import STRING, split_top_level, text_between, tokens, value_ends
from cipherledger.functions.text import (
    blank_out,
    blank_to_null,
    each,
    first_match,
    let,
    line_at,
    newlines,
    occurrences,
    record,
    running_sums,
    strip,
    text_lines,
    without_marks,
)

ERROR = "python.ast.error"
TOKEN = "(?i)" + vocab.PY_ALGORITHM_TOKEN
# triple-quoted strings and comments go, ordinary strings (group 1) stay
_LEXEME = (
    r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|(\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+')|#[^\n]*"
)
_MODULE = "^(?:" + "|".join(re.escape(m) for m in vocab.CRYPTO_MODULES) + r")(?:\.|$)"
_IMPORT = r"(?m)^[ \t]*import[ \t]+([^\n;]+)"
_FROM = r"(?m)^[ \t]*from[ \t]+\.*([\w.]*)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n;]+))"
_NAME_AS = r"^\s*([\w.*]+)(?:\s+as\s+(\w+))?\s*$"


_TARGET = r"[A-Za-z_][\w.]*[ \t]*(?::[^=\n;]+)?=(?!=)[ \t]*"
_ASSIGN = rf"(?m)(?:^|;)[ \t]*((?:{_TARGET})+)"
_STATED = r"[ \t]*(?=;|$)"
_ASSIGN_STRING = _ASSIGN + r"\(?[rRuU]?(\"[^\"\n]*\"|'[^'\n]*')\)?" + _STATED
_ASSIGN_ATTRIBUTE = _ASSIGN + r"([A-Za-z_]\w*(?:\.\w+)+)" + _STATED
# strings, keys that are one token, opening brackets behind targets or a called name, other brackets
_STRUCTURE = (
    rf"([\"'])(?i:{vocab.PY_ALGORITHM_TOKEN})\1\s*:[ \t]*|{STRING}|(?m:^|(?<=;))[ \t]*((?:{_TARGET})+)([(\[{{])"
    r"|(?<![\w.])(?<!def )(?<!class )([A-Za-z_][\w.]*)[ \t]*(\()|([(\[{])|([)\]}])"
)
_ELEMENT = rf"^[bBrRuU]{{0,2}}(?:{STRING})$"
# a triple-quoted string behind other text of its line is a value, not documentation
_LONG_VALUE = r"(?=[\"'])(?<=[^\s\"'][ \t]{0,8})(\"\"\"|''')([^\"'\\\n]*)\1"


def is_crypto_module(module: Column) -> Column:
    """The module is a known one or lies below one."""
    return F.coalesce(F.rlike(module, F.lit(_MODULE)), F.lit(False))


def algorithm_token(text: Column) -> Column:
    """First algorithm token of a text in its own spelling, null when there is none."""
    return first_match(text, TOKEN)


@F.pandas_udf(BooleanType())
def parses(content: pd.Series) -> pd.Series:
    """Whether the text is valid Python; false for null."""

    def ok(text: str | None) -> bool:
        if text is None:
            return False
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False

    return content.map(ok)


def clean_files(files: DataFrame) -> DataFrame:
    """Files that can hold findings: ``_lines`` for snippets and ``_code`` without comments and doc strings.

    Only files with a crypto module name or an algorithm token are kept.
    """
    keys = [c for c in files.columns if c != "content"]
    tops = sorted({m.split(".")[0] for m in vocab.CRYPTO_MODULES})
    likely = files.filter(F.rlike("content", F.lit(r"\b(?:" + "|".join(tops) + r")\b")) | F.rlike("content", F.lit(TOKEN)))
    text = F.regexp_replace(without_marks(F.col("content")), _LONG_VALUE, '"$2"')
    return likely.select(*keys, F.col("content").alias("_source"), text_lines(F.col("content")).alias("_lines"), blank_out(text, _LEXEME).alias("_code"))


# --- facts ---------------------------------------------------------------------------

# kind, pattern, groups behind a and b
FACTS = [("string", _ASSIGN_STRING, 1, 2), ("attribute", _ASSIGN_ATTRIBUTE, 1, 2)]


def _structured(code: Column) -> Column:
    """Calls, assigned sequences and keys as array<struct<kind, line, a, b>>."""

    def facts(x: Column) -> Column:
        raw, found = x["raw"], x["found"]

        def group(t: Column, k: Column) -> Column:
            partner = F.get(found, k + 1)
            called = record(kind=F.lit("call"), line=t["line"], a=t["name"], b=text_between(raw, t["stop"], partner["start"]))
            stated = F.rlike(partner["after"], F.lit(r"^[ \t]*[;\n]")) | (partner["last"] & F.rlike(partner["after"], F.lit(r"^[ \t]*$")))
            assigned = record(kind=F.lit("sequence"), line=t["line"], a=t["targets"], b=text_between(raw, t["stop"] - 1, partner["stop"]))
            # a bracket without partner has the next group of its depth behind it
            return F.when((t["delta"] <= 0) | (partner["delta"] >= 0) | (partner["depth"] != t["depth"]), None).when(t["name"] != "", called).when(
                (t["targets"] != "") & stated, assigned
            )

        def keyed(ends: Column) -> Column:
            return F.transform(
                found,
                lambda t, k: F.when(t["key"] != "", record(kind=F.lit("key"), line=t["line"], a=t["key"], b=text_between(raw, t["stop"], F.get(ends, k)))),
            )

        keys = F.when(F.exists(found, lambda t: t["key"] != ""), let(value_ends(found), keyed))
        groups = F.transform(found, group)
        return F.filter(F.concat(groups, F.coalesce(keys, F.slice(groups, F.lit(1), F.lit(0)))), lambda f: f.isNotNull())

    found = tokens(code, _STRUCTURE, {"key": "$2", "targets": "$3", "name": "$5"}, opens="$4$6$7", closes="$8")
    return let(record(raw=code.cast("binary"), found=found), facts)


def _imported(listing: Column) -> Column:
    """'x as y, z' -> array<struct<name, local>>."""
    good = F.filter(F.split(listing, ","), lambda n: F.rlike(n, F.lit(_NAME_AS)))
    return F.transform(
        good,
        lambda n: record(name=F.regexp_extract(n, _NAME_AS, 1), local=F.coalesce(first_match(n, _NAME_AS, 2), F.regexp_extract(n, _NAME_AS, 1))),
    )


def _bindings(kind: str, found: Column) -> Column:
    """Imports of crypto modules as array<struct<kind, line, module, name, local, target>>."""

    def bind(m: Column, n: Column) -> Column:
        module = n["name"] if kind == "import" else m["a"]
        target = n["name"] if kind == "import" else F.concat_ws(".", m["a"], n["name"])
        return record(kind=F.lit(kind), line=m["line"], module=module, name=n["name"], local=n["local"], target=target)

    each = F.flatten(F.transform(found, lambda m: F.transform(_imported(m["b"]), lambda n: bind(m, n))))
    return F.filter(each, lambda x: is_crypto_module(x["module"]))


def _tagged(kind: str, found: Column) -> Column:
    return F.transform(
        found, lambda m: record(kind=F.lit(kind), line=m["line"], a=m["a"], b=m["b"])
    )


def _looked_up(name: Column) -> Column:
    return F.coalesce(F.try_element_at("_names", name), name)


def file_facts(code: DataFrame, check_syntax: bool = True) -> DataFrame:
    """Per file: ``_imports`` (bindings), ``_facts`` and ``_broken`` (it has facts and is not valid).

    A fact carries all that its findings need of the file: the lines it stands on and
    the full names behind its own, so that rows of single facts are narrow. The syntax
    check runs on files with a fact only.
    """
    keys = [c for c in code.columns if c not in ("_source", "_lines", "_code")]
    text = F.col("_code")
    plain = F.transform(occurrences(text, _IMPORT, b=1), lambda m: record(line=m["line"], a=F.lit(""), b=m["b"]))
    named = F.transform(
        occurrences(text, _FROM, a=1, i=2, p=3),
        lambda m: record(line=m["line"], a=m["a"], b=F.coalesce(blank_to_null(m["i"]), m["p"])),
    )
    facts = F.concat(_structured(text), *[_tagged(kind, occurrences(text, pattern, a=a, b=b)) for kind, pattern, a, b in FACTS])
    rows = code.select(*keys, "_source", "_lines", plain.alias("_p"), named.alias("_n"), facts.alias("_stated"))
    bound = F.concat(_bindings("import", F.col("_p")), _bindings("from", F.col("_n")))
    rows = rows.select(*keys, "_source", "_lines", "_stated", bound.alias("_bound"))
    # a filter on the lists would be pushed down and compute them twice: files that are not valid keep a row with empty lists
    told_any = (F.size("_stated") > 0) | (F.size("_bound") > 0)
    rows = rows.withColumn("_valid", parses(F.when(told_any, F.col("_source"))) if check_syntax else F.lit(True))
    # the last binding of a local name counts
    ordered = F.array_sort(F.transform("_bound", lambda x: record(local=x["local"], line=x["line"], target=x["target"])))
    rows = rows.withColumn("_o", ordered)
    last = F.filter("_o", lambda x, i: F.coalesce(F.get("_o", i + 1)["local"] != x["local"], F.lit(True)))
    rows = rows.withColumn("_names", F.map_from_entries(F.transform(last, lambda x: F.struct(x["local"], x["target"]))))
    imports = F.transform(
        "_bound",
        lambda x: record(
            kind=x["kind"], line=x["line"], module=x["module"], name=x["name"], local=x["local"], target=x["target"],
            snippet=line_at(F.col("_lines"), x["line"]),
        ),
    )

    def told(x: Column) -> Column:
        first = F.get(F.split(x["a"], r"\."), F.lit(0))
        owner = F.when(x["kind"] == "attribute", F.regexp_extract(x["b"], r"^(.*)\.\w+$", 1))
        shown = F.when(x["kind"] == "sequence", F.size(F.split(x["b"], "\n"))).when(x["kind"].isin("string", "attribute"), 1).otherwise(0)
        return record(
            kind=x["kind"], line=x["line"], a=x["a"], b=x["b"], lines=F.slice("_lines", x["line"], shown),
            base=_looked_up(first), owner=_looked_up(owner), imports=F.size("_bound") > 0,
        )

    valid = F.col("_valid")
    return rows.select(
        *keys, F.when(valid, imports).alias("_imports"), F.when(valid, F.transform("_stated", told)).alias("_facts"), (told_any & ~valid).alias("_broken")
    )


def import_facts(files: DataFrame, check_syntax: bool = True) -> DataFrame:
    """Import facts table: kind, line, module, name, local, target."""
    keys = [c for c in files.columns if c != "content"]
    return each(file_facts(clean_files(files), check_syntax), keys, F.col("_imports"), "_x").select(*keys, "_x.*").drop("snippet")


def call_facts(files: DataFrame, check_syntax: bool = True) -> DataFrame:
    """Call facts table: line, callee, args, local (first segment), attr (last segment), depth."""
    keys = [c for c in files.columns if c != "content"]
    rows = each(file_facts(clean_files(files), check_syntax), keys, F.col("_facts"), "_x").select(*keys, "_x.*").filter("kind = 'call'")
    parts = F.split("a", r"\.")
    return rows.select(
        *keys, "line", F.col("a").alias("callee"), F.col("b").alias("args"), F.get(parts, F.lit(0)).alias("local"),
        F.element_at(parts, -1).alias("attr"), F.size(parts).alias("depth"),
    )


def resolve_facts(facts: DataFrame, imported: DataFrame, keys: list[str], local: str = "local", out: str = "base") -> DataFrame:
    """Full name behind a local name; the local name itself when the file does not bind it."""
    bound = imported.groupBy(*keys, F.col("local").alias(local)).agg(F.max_by("target", F.struct("line", "target")).alias("_target"))
    return facts.join(bound, [*keys, local], "left").withColumn(out, F.coalesce("_target", local)).drop("_target")


# --- calls ---------------------------------------------------------------------------

_IS_STRING = r"^[rRuU]?(?:\"[^\"]*\"|'[^']*')$"
_IS_ATTRIBUTE = r"^[A-Za-z_]\w*(?:\.\w+)+$"
_IS_KEYWORD = r"^([A-Za-z_]\w*)\s*=(?!=)\s*([\s\S]*)$"
_KEYWORDS = "^(?:" + "|".join(vocab.ARGUMENT_KEYWORDS) + ")$"


def _value_token(value: Column) -> Column:
    """Token of a string constant or of the last attribute name."""
    return F.when(F.rlike(value, F.lit(_IS_STRING)), algorithm_token(value)).when(
        F.rlike(value, F.lit(_IS_ATTRIBUTE)), algorithm_token(F.regexp_extract(value, r"\.(\w+)$", 1))
    )


def argument_hints(args: Column) -> Column:
    """Tokens in positional strings and attributes, and in the values of known keywords."""
    parts = F.filter(F.transform(split_top_level(args), strip), lambda a: a != "")

    def hints(a: Column) -> Column:
        value = F.regexp_extract(a, _IS_KEYWORD, 2)
        elements = F.regexp_extract_all(value, F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1))
        callee = F.regexp_extract(value, r"^([A-Za-z_][\w.]*)\s*\(", 1)
        called = F.coalesce(
            algorithm_token(F.element_at(F.split(callee, r"\."), -1)), F.when(F.rlike(callee, F.lit(r"^hmac\.(?:new|digest|HMAC)$")), "HMAC")
        )
        by_keyword = F.when(F.rlike(value, F.lit(r"^[\[({]")), F.transform(elements, algorithm_token)).when(
            callee != "", F.array(called)
        ).otherwise(F.array(_value_token(value)))
        return F.when(~F.rlike(a, F.lit(_IS_KEYWORD)), F.array(_value_token(a))).when(
            F.rlike(F.regexp_extract(a, _IS_KEYWORD, 1), F.lit(_KEYWORDS)), by_keyword
        ).otherwise(F.array().cast("array<string>"))

    return F.array_compact(F.flatten(F.transform(parts, hints)))


def is_crypto_call(attr: Column, depth: Column, base: Column) -> Column:
    """On a crypto module, on a name imported from one, or a known method further down."""
    return (
        F.when(depth == 1, is_crypto_module(F.get(F.split(base, r"\."), F.lit(0))))
        .when(depth == 2, is_crypto_module(base))
        .otherwise(attr.isin(vocab.CHAINED_METHODS) & is_crypto_module(base))
    )


def called_algorithm(attr: Column, depth: Column, base: Column) -> Column:
    hmac_attr = (depth == 2) & ((base == "hmac") | base.startswith("hmac.")) & attr.isin("new", "digest", "HMAC")
    hmac_name = (depth == 1) & base.isin("hmac.new", "hmac.digest", "hmac.HMAC")
    return F.coalesce(algorithm_token(attr), F.when(hmac_attr | hmac_name, "HMAC"))


def call_hints(inferred: Column, in_args: Column) -> Column:
    """HMAC first if called, then the tokens in the arguments, else the called algorithm; UNKNOWN if nothing."""
    none = F.array().cast("array<string>")
    is_hmac = F.coalesce(F.upper(inferred) == "HMAC", F.lit(False))
    listed = F.concat(F.when(is_hmac, F.array(F.lit("HMAC"))).otherwise(none), in_args)
    return F.when(F.size(listed) > 0, listed).when(inferred.isNotNull(), F.array(inferred)).otherwise(F.array(F.lit("UNKNOWN")))


# --- findings --------------------------------------------------------------------------


def _hit(detector: str, line: Column, signal: Column, roles: Column | list[str], hint: Column, confidence: Column | float) -> Column:
    roles = roles if isinstance(roles, Column) else F.array(*[F.lit(r) for r in roles])
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return record(line=line.cast("int"), detector=F.lit(detector), raw_signal=signal, roles=roles, algorithm_hint=hint, confidence=confidence.cast("double"))


def _import_hits() -> Column:
    """A bare import shows a library; a from-import an algorithm if its name or last two module segments do."""
    m = F.col("m")
    parts = F.split(m["module"], r"\.")
    token = F.coalesce(
        algorithm_token(m["name"]), algorithm_token(F.element_at(parts, -1)), algorithm_token(F.try_element_at(parts, F.lit(-2)))
    )
    return F.when(
        m["kind"] == "import",
        _hit("python.ast.import", m["line"], m["snippet"], ["capability"], F.get(parts, F.lit(0)), 0.5),
    ).when(token.isNotNull(), _hit("python.ast.import_from", m["line"], m["snippet"], ["implementation"], token, 0.75))


def _contains_any(name: Column, words: list[str]) -> Column:
    return F.rlike(F.lower(name), F.lit("|".join(words)))


def _last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _configured(value: Column, target: Column, words: list[str]) -> Column:
    """Token of a string value that its target name announces or that it fills completely."""
    token = algorithm_token(value)
    return F.when(_contains_any(_last_segment(target), words) | (F.upper(token) == F.upper(value)), token)


def _string_elements(parts: Column) -> Column:
    """Parts of a sequence that are strings, as array<struct<value, breaks>> with the line breaks before them."""
    before = running_sums(F.transform(parts, newlines))

    def element(part: Column, i: Column) -> Column:
        ahead = F.coalesce(F.get(before, i - 1), F.lit(0)) + newlines(F.regexp_extract(part, r"^\s*", 0))
        whole = strip(part)
        return F.when(
            F.rlike(whole, F.lit(_ELEMENT)), record(value=F.regexp_extract(whole, r"^[bBrRuU]{0,2}[\"']([\s\S]*)[\"']$", 1), breaks=ahead)
        )

    return F.filter(F.transform(parts, element), lambda e: e.isNotNull() & (e["value"] != ""))


def _fact_hits() -> Column:
    """Findings of one fact row as an array."""
    kind, line, a, b, lines = (F.col(c) for c in ("kind", "line", "a", "b", "lines"))
    snippet = line_at(lines, F.lit(1))
    configuration = ["configuration"]
    # an assignment may name several targets; each is one finding
    targets = F.regexp_extract_all(a, F.lit(r"([A-Za-z_][\w.]*)[ \t]*(?::[^=\n;]+)?=(?!=)"), F.lit(1))

    def each_target(hit) -> Column:
        return F.filter(F.transform(targets, hit), lambda h: h["algorithm_hint"].isNotNull())

    text = F.regexp_extract(b, r"^[\"']([\s\S]*)[\"']$", 1)
    string = each_target(lambda t: _hit("python.ast.assignment", line, snippet, configuration, _configured(text, t, vocab.ASSIGN_KEYWORDS), 0.55))

    is_tuple = ~b.startswith("(") | b.contains(",")
    is_list = is_tuple & (~b.startswith("{") | ~F.rlike(b, F.lit(r"[\"']\s*:")))
    inside = F.substring(b, F.lit(2), F.greatest(F.length(b) - 2, F.lit(0)))
    elements = F.when(is_list, let(split_top_level(inside), _string_elements))

    def listed(t: Column, e: Column) -> Column:
        hint = _configured(e["value"], t, vocab.SEQUENCE_KEYWORDS)
        return _hit("python.ast.assignment", line + e["breaks"], line_at(lines, e["breaks"] + 1), configuration, hint, 0.55)

    found = let(elements, lambda es: F.flatten(F.transform(targets, lambda t: F.transform(es, lambda e: listed(t, e)))))
    sequence = F.filter(found, lambda h: h["algorithm_hint"].isNotNull())

    on_module = is_crypto_module(F.col("owner")) | F.col("owner").isin("hashlib", "hashes", "cryptography")
    named = F.when(on_module, algorithm_token(_last_segment(b)))
    attribute = each_target(lambda t: _hit("python.ast.attribute", line, snippet, ["implementation"], named, 0.75))

    key_token = algorithm_token(a)
    key = F.when((F.upper(key_token) == F.upper(a)) & F.col("imports"), key_token)

    parts = F.split(a, r"\.")
    attr, depth, base = F.element_at(parts, -1), F.size(parts), F.col("base")
    shown = F.concat(a, F.lit("("), b, F.lit(")"))
    unresolved = lambda h: h == "UNKNOWN"
    only_code = lambda h: unresolved(h) | (F.upper(h) == "HMAC")
    call = F.when(
        is_crypto_call(attr, depth, base),
        F.transform(
            call_hints(called_algorithm(attr, depth, base), argument_hints(b)),
            lambda h: _hit(
                "python.ast.call", line, shown,
                F.when(only_code(h), F.array(F.lit("implementation"))).otherwise(F.array(F.lit("implementation"), F.lit("usage"))),
                h, F.when(unresolved(h), 0.65).otherwise(0.85),
            ),
        ),
    )
    registry = _hit("python.ast.registry", line, F.concat(a, F.lit(": "), strip(b)), ["implementation", "configuration"], key, 0.80)
    return (
        F.when(kind == "call", call)
        .when(kind == "string", string)
        .when(kind == "sequence", sequence)
        .when(kind == "attribute", attribute)
        .otherwise(F.when(key.isNotNull(), F.array(registry)))
    )


def scan_python(files: DataFrame, check_syntax: bool = True, errors: bool = False) -> DataFrame:
    """All Python findings of a files table (key columns, ``path``, ``content``).

    With ``errors``, a file that has facts but is not valid gives one row of the detector ERROR.
    """
    keys = [c for c in files.columns if c != "content"]
    imported = F.transform("_imports", lambda x: record(m=x, f=F.lit(None).cast(_FACT)))
    stated = F.transform("_facts", lambda x: record(m=F.lit(None).cast(_BINDING), f=x))
    all_facts = F.concat(imported, stated)
    if errors:
        failed = record(m=F.lit(None).cast(_BINDING), f=F.lit(None).cast(_FACT))
        all_facts = F.when(F.col("_broken"), F.array(failed)).otherwise(all_facts)
    rows = file_facts(clean_files(files), check_syntax).select(*keys, all_facts.alias("_all"))
    facts = each(rows, keys, F.col("_all"), "_x").select(*keys, "_x.m", "_x.f.*")
    binding = _import_hits()
    hits = F.when(F.col("m").isNotNull(), F.when(binding.isNotNull(), F.array(binding))).when(F.col("kind").isNotNull(), _fact_hits())
    if errors:
        failed = _hit(ERROR, F.lit(0), F.lit("not valid"), F.array().cast("array<string>"), F.lit(None).cast("string"), 0.0)
        hits = F.when(F.col("m").isNull() & F.col("kind").isNull(), F.array(failed)).otherwise(hits)
    found = each(facts, keys, hits, "_h").select(*keys, "_h.*")
    return found.withColumn("source_type", F.lit("python_source"))


_FACT = "struct<kind:string,line:int,a:string,b:string,lines:array<string>,base:string,owner:string,imports:boolean>"
_BINDING = "struct<kind:string,line:int,module:string,name:string,local:string,target:string,snippet:string>"
