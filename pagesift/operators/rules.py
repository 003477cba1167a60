"""Rules stated as data, compiled to columns.

A rule names a fact by its dotted path, states by a JSON-Schema subset what to expect of it, and may have
guards. ``verdict`` gives null where the rule doesn't apply, else whether the fact is as expected. Keywords
judge values of their own type and pass others: only type, const and enum fail on an absent value.
All rules over one table share one scan; only failing rows are unfolded.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions import scoring, strings

KEYWORDS = frozenset(
    "type const enum pattern minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength minItems maxItems items contains minContains maxContains "
    "properties required minProperties not allOf anyOf if then else format".split()
)


@dataclass(frozen=True)
class Fact:
    """A column with its Spark type; ``kind`` is null for a path that the schema doesn't have."""

    column: Column
    kind: T.DataType | None

    def get(self, name: str) -> Fact:
        if isinstance(self.kind, T.StructType):
            if name not in self.kind.fieldNames():
                name = name.replace("-", "_")  # a field may be written with either
            if name not in self.kind.fieldNames():
                return Fact(F.lit(None), None)
            return Fact(self.column.getField(name), self.kind[name].dataType)
        if isinstance(self.kind, T.MapType):
            return Fact(F.try_element_at(self.column, F.lit(name)), self.kind.valueType)
        if isinstance(self.kind, T.ArrayType) and name.isdigit():
            return Fact(F.try_element_at(self.column, F.lit(int(name) + 1)), self.kind.elementType)
        return Fact(F.lit(None), None)


def fact(df: DataFrame, path: str) -> Fact:
    """The fact at a dotted path; a map's key may itself hold dots, so the longest key that ends the path is tried last."""
    first, *rest = path.split(".")
    if first not in df.columns:
        return Fact(F.lit(None), None)
    at = Fact(F.col(first), df.schema[first].dataType)
    for i, name in enumerate(rest):
        if isinstance(at.kind, T.MapType) and not isinstance(at.kind.valueType, (T.StructType, T.MapType)):
            return at.get(".".join(rest[i:]))
        at = at.get(name)
    return at


def _is(kind: T.DataType | None, name: str) -> bool:
    number = isinstance(kind, T.NumericType)
    return {
        "string": isinstance(kind, T.StringType), "boolean": isinstance(kind, T.BooleanType), "array": isinstance(kind, T.ArrayType),
        "object": isinstance(kind, (T.StructType, T.MapType)), "number": number, "integer": number, "null": False,
    }[name]


def _type_is(f: Fact, name: str) -> Column:
    if not _is(f.kind, name):
        return F.lit(False)
    there = f.column.isNotNull()
    if name == "integer" and not isinstance(f.kind, T.IntegralType):
        return there & (f.column == F.floor(f.column))
    return there


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def expectation(f: Fact, schema: Mapping[str, Any] | bool) -> Column:
    """A column that is never null: whether the fact meets the schema."""
    if isinstance(schema, bool):
        return F.lit(True) if schema else f.column.isNull()
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"keywords not known: {sorted(unknown)}")
    x, parts = f.column, []

    def when_of(name: str, test: Callable[[], Column]) -> None:
        if _is(f.kind, name):
            parts.append(x.isNull() | F.coalesce(test(), F.lit(False)))

    for key, want in schema.items():
        match key:
            case "type":
                names = [want] if isinstance(want, str) else want
                parts.append(reduce(lambda a, b: a | b, [_type_is(f, n) for n in names]))
            case "const":
                parts.append(_equals(f, want))
            case "enum":
                parts.append(reduce(lambda a, b: a | b, [_equals(f, w) for w in want], F.lit(False)))
            case "pattern":
                when_of("string", lambda w=want: x.rlike(w))
            case "format":
                when_of("string", lambda: F.try_parse_url(x, F.lit("PROTOCOL")).isNotNull())
            case "minLength":
                when_of("string", lambda w=want: F.length(x) >= w)
            case "maxLength":
                when_of("string", lambda w=want: F.length(x) <= w)
            case "minimum":
                when_of("number", lambda w=want: x >= w)
            case "maximum":
                when_of("number", lambda w=want: x <= w)
            case "exclusiveMinimum":
                when_of("number", lambda w=want: x > w)
            case "exclusiveMaximum":
                when_of("number", lambda w=want: x < w)
            case "minItems":
                when_of("array", lambda w=want: F.size(x) >= w)
            case "maxItems":
                when_of("array", lambda w=want: F.size(x) <= w)
            case "items":
                when_of("array", lambda w=want: F.forall(x, lambda e: expectation(Fact(e, f.kind.elementType), w)))
            case "contains":
                low, high = schema.get("minContains", 1), schema.get("maxContains")
                count = lambda w=want: F.size(F.filter(x, lambda e: expectation(Fact(e, f.kind.elementType), w)))
                when_of("array", lambda low=low, high=high, count=count: (count() >= low) & (count() <= high if high is not None else F.lit(True)))
            case "required":
                when_of("object", lambda w=want: _all([f.get(n).column.isNotNull() for n in w]))
            case "properties":
                when_of("object", lambda w=want: _all([f.get(n).column.isNull() | expectation(f.get(n), s) if s is not False else f.get(n).column.isNull() for n, s in w.items()]))
            case "minProperties":
                when_of("object", lambda w=want: F.size(F.map_keys(x)) >= w if isinstance(f.kind, T.MapType) else _present(f) >= w)
            case "not":
                parts.append(~expectation(f, want))
            case "allOf":
                parts.append(_all([expectation(f, s) for s in want]))
            case "anyOf":
                parts.append(reduce(lambda a, b: a | b, [expectation(f, s) for s in want]))
            case "if":
                parts.append(F.when(expectation(f, want), expectation(f, schema.get("then", True))).otherwise(expectation(f, schema.get("else", True))))
    return _all(parts)


def _present(f: Fact) -> Column:
    return reduce(lambda a, b: a + b, [f.get(n).column.isNotNull().cast("int") for n in f.kind.fieldNames()], F.lit(0))


def _comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def _equals(f: Fact, want: Any) -> Column:
    """Deep equality with a constant. An absent value equals nothing, null neither."""
    if isinstance(want, list):
        if not isinstance(f.kind, T.ArrayType):
            return F.lit(False)
        each = [_equals(Fact(F.get(f.column, F.lit(i)), f.kind.elementType), w) for i, w in enumerate(want)]
        return F.coalesce(F.size(f.column) == len(want), F.lit(False)) & _all(each)
    if isinstance(want, Mapping):
        if isinstance(f.kind, T.MapType):
            fits = F.coalesce(F.size(F.map_keys(f.column)) == len(want), F.lit(False))
        elif isinstance(f.kind, T.StructType):
            fits = f.column.isNotNull() & (F.coalesce(_present(f), F.lit(0)) == len(want))
        else:
            return F.lit(False)
        return fits & _all([_equals(f.get(n), w) for n, w in want.items()])
    if f.kind is None or not _comparable(f.kind, want):
        return F.lit(False)
    return F.coalesce(f.column == F.lit(want), F.lit(False))


def _at(path: str, name: Any) -> str:
    return f"{path}.{name}" if path else str(name)


def first_failure(f: Fact, schema: Mapping[str, Any] | bool, path: Column | str = "") -> Column:
    """struct(path, keyword) of the first keyword that the fact breaks, type before others and then in the schema's
    order; the path leads to the part that breaks it. Null where the fact is as expected."""
    here = path if isinstance(path, Column) else F.lit(path)
    said = lambda ok, keyword: F.when(~ok, F.struct(here.alias("path"), F.lit(keyword).alias("keyword")))
    if isinstance(schema, bool):
        return said(expectation(f, schema), "false schema")
    below = lambda name: F.concat_ws(".", F.nullif(here, F.lit("")), name if isinstance(name, Column) else F.lit(name))
    found = []
    for key in sorted(schema, key=lambda k: k != "type"):
        want = schema[key]
        if key in ("then", "else", "minContains", "maxContains") and ("if" in schema or "contains" in schema):
            continue
        alone = {key: want, **{k: schema[k] for k in ("minContains", "maxContains") if key == "contains" and k in schema}}
        if key == "properties" and _is(f.kind, "object"):
            found += [F.when(f.column.isNotNull() & f.get(n).column.isNotNull(), first_failure(f.get(n), s, below(n))) for n, s in want.items()]
        elif key == "items" and _is(f.kind, "array"):
            each = F.transform(f.column, lambda e, i: first_failure(Fact(e, f.kind.elementType), want, below(i.cast("string"))))
            found.append(F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0)))
        elif key == "allOf":
            found += [first_failure(f, s, here) for s in want]
        elif key == "if":
            found.append(F.when(expectation(f, want), first_failure(f, schema.get("then", True), here)).otherwise(first_failure(f, schema.get("else", True), here)))
        else:
            found.append(said(expectation(f, alone), key))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<path: string, keyword: string>")


def missing_members(f: Fact, schema: Mapping[str, Any]) -> Column:
    """The strings that an allOf of contains asks for and the list lacks."""
    wanted = [w for s in schema.get("allOf", ()) if isinstance(w := s.get("contains", {}).get("const"), str)]
    if not wanted or not isinstance(f.kind, T.ArrayType):
        return F.array().cast("array<string>")
    return F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(f.column.cast("array<string>"), F.array().cast("array<string>")))


def got(f: Fact) -> Column:
    """The value as a message shows it."""
    if isinstance(f.kind, T.ArrayType):
        plain = isinstance(f.kind.elementType, (T.StringType, T.NumericType))
        return strings.shown(f.column, "list") if plain else F.when(F.size(f.column) > 0, strings.shown(f.column, "json")).otherwise("none")
    if f.kind is None:
        return F.lit("none")
    kind = "string" if isinstance(f.kind, T.StringType) else "json" if isinstance(f.kind, (T.StructType, T.MapType)) else "scalar"
    return strings.shown(f.column, kind)


def message(df: DataFrame, rule: Rule) -> Column:
    """The sentence of a failing cell: the rule's template over {got} and {field}, else what keyword broke where."""
    f = fact(df, rule.fact)
    broken = first_failure(f, rule.expect)
    exact = got(f)
    if isinstance(f.kind, T.StringType):
        exact = F.when(broken["keyword"].isin("const", "enum") & f.column.isNotNull(), F.concat(F.lit("“"), f.column, F.lit("”"))).otherwise(exact)
    if rule.text:
        return strings.filled(F.lit(rule.text), {"got": exact, "field": F.coalesce(F.nullif(broken["path"], F.lit("")), F.lit(rule.fact.rsplit(".", 1)[-1]))})
    place = F.concat_ws(".", F.lit(rule.fact), F.nullif(broken["path"], F.lit("")))
    return F.when(f.column.isNull(), F.lit(f"{rule.fact} is absent")).otherwise(F.concat(place, F.lit(" breaks "), broken["keyword"], F.lit(" (got "), exact, F.lit(")")))


@dataclass(frozen=True)
class Rule:
    """A rule over the facts of each row. ``when`` maps paths to a value or a schema; ``scale`` maps a numeric fact to a score.

    ``linked`` is for rules about subjects: whether hosts count that the site only links to."""

    id: str
    fact: str
    expect: Mapping[str, Any] | bool
    when: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "warning"
    score: float | None = None
    scale: tuple[tuple[float, float], ...] | None = None
    text: str = ""
    linked: bool = False


def _withheld(df: DataFrame, path: str) -> list[Column]:
    """Conditions that no part along the path says that robots.txt withheld its probe."""
    names, conditions = path.split("."), []
    for i in range(1, len(names)):
        at = fact(df, ".".join(names[:i]))
        if isinstance(at.kind, T.StructType) and "disallowed" in at.kind.fieldNames():
            conditions.append(~F.coalesce(at.get("disallowed").column, F.lit(False)))
    return conditions


def verdict(df: DataFrame, rule: Rule, always: frozenset[str] = frozenset()) -> Column:
    """Null: skipped. A rule is skipped where its fact's root is absent, where a guard doesn't hold, or where robots.txt
    withheld the probe that the fact comes from. Roots in ``always`` count as present even when null."""
    root = rule.fact.split(".")[0]
    applies = [] if root in always else [F.col(root).isNotNull() if root in df.columns else F.lit(False)]
    applies += _withheld(df, rule.fact)
    for path, want in rule.when.items():
        f = fact(df, path)
        applies.append(expectation(f, want if isinstance(want, Mapping) else {"const": want}))
    return F.when(_all(applies), expectation(fact(df, rule.fact), rule.expect))


def rule_score(df: DataFrame, rule: Rule) -> Column:
    """A fixed score, else one read off the scale, else the level's own; kept within the level's band if the level is given."""
    if rule.scale:
        score = F.coalesce(scoring.interpolated(fact(df, rule.fact).column, rule.scale), F.lit(scoring.BANDS[rule.severity][2]))
    else:
        score = F.lit(float(scoring.BANDS[rule.severity][2] if rule.score is None else rule.score))
    return scoring.pinned(F.lit(rule.severity), score)


#: Rules per generated list, to keep generated methods small.
CHUNK = 50


def evaluate(df: DataFrame, rules: list[Rule], keys: list[str], always: frozenset[str] = frozenset()) -> DataFrame:
    """(keys, rule, ok): one row for each row of ``df`` and rule that applies to it; one scan for all rules."""
    lists = []
    for at in range(0, len(rules), CHUNK):
        cells = [F.struct(F.lit(r.id).alias("rule"), verdict(df, r, always).alias("ok"), F.lit(r.severity).alias("severity"), rule_score(df, r).alias("score")) for r in rules[at : at + CHUNK]]
        lists.append(F.filter(F.array(*cells), lambda c: c["ok"].isNotNull()))
    return df.select(*keys, F.explode(F.concat(*lists)).alias("c")).select(*keys, "c.rule", "c.ok", "c.severity", "c.score")


def findings(df: DataFrame, rules: list[Rule], keys: list[str], always: frozenset[str] = frozenset()) -> DataFrame:
    """The failing cells alone, with their sentences: rows without failure are gone before anything is unfolded."""
    lists = []
    for at in range(0, len(rules), CHUNK):
        cells = [F.when(~verdict(df, r, always), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), rule_score(df, r).alias("score"), message(df, r).alias("text"))) for r in rules[at : at + CHUNK]]
        lists.append(F.filter(F.array(*cells), lambda c: c.isNotNull()))
    return df.select(*keys, F.explode(F.concat(*lists)).alias("c")).select(*keys, "c.*")


def with_site(df: DataFrame, site: DataFrame) -> DataFrame:
    """Every row with the one row of ``site`` as the struct ``site``, which guards may ask: ``site.role`` and the like."""
    return df.crossJoin(F.broadcast(site.limit(1).select(F.struct("*").alias("site"))))


def subject_findings(subjects: DataFrame, rules: list[Rule], kind: str) -> DataFrame:
    """(name, rule, severity, score, text): failing rules whose fact is ``site.<kind>.*.<extractor>.<path>``, kind being origins or hosts.

    ``subjects`` has a row for each origin or host: name, linked (whether the site only links to it) and a struct for
    each extractor, and may have the struct ``site``. A rule judges the subjects that carry its extractor; of its
    guards those about the same kind of subject count, and those about the site as a whole."""
    prefix, judged = f"site.{kind}.*.", []
    for r in rules:
        if not r.fact.startswith(prefix):
            continue
        of_site = {p: w for p, w in r.when.items() if p.startswith("site.") and not p.startswith(("site.origins.", "site.hosts."))}
        own = {p.removeprefix(prefix): w for p, w in r.when.items() if p.startswith(prefix)}
        judged.append(replace(r, fact=r.fact.removeprefix(prefix), when={**own, **of_site, **({} if r.linked else {"linked": False})}))
    return findings(subjects, judged, ["name"])


def unique_violations(df: DataFrame, value: str, key: str, within: list[str] | None = None) -> DataFrame:
    """(within, value, pages, keys): values that two distinct keys or more share; null values are none.

    Distinct pairs are counted first, within tasks before the shuffle; only values that are shared list their keys."""
    by = [*(within or []), value]
    pairs = df.where(F.col(value).isNotNull()).select(*by, key).distinct()
    shared = pairs.groupBy(*by).agg(F.count("*").alias("pages")).where("pages > 1")
    return pairs.join(shared, by).groupBy(*by, "pages").agg(F.array_sort(F.collect_list(key)).alias("keys")).select(*by, "pages", "keys")


def shared_values(df: DataFrame, value: str, key: str, within: list[str] | None = None) -> DataFrame:
    """(within, value, pages, key): the same as rows, one for each key, for values that very many pages may share."""
    by = [*(within or []), value]
    pairs = df.where(F.col(value).isNotNull()).select(*by, key).distinct()
    return pairs.join(pairs.groupBy(*by).agg(F.count("*").alias("pages")).where("pages > 1"), by).select(*by, "pages", key)


def first_match(value: Column, patterns: list[tuple[str, str]], default: str = "default") -> Column:
    """The name of the first pattern (name, regular expression) that matches."""
    out = F.lit(default)
    for name, pattern in reversed(patterns):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def assign_group(path: Column, content_type: Column, groups: Mapping[str, list[str]], default: str = "default") -> Column:
    """The first group one of whose entries matches: ``re:`` and a regular expression over path and query,
    ``content-type:`` and the beginning of a media type, else a glob over path and query."""

    def hit(entry: str) -> Column:
        if entry.startswith("re:"):
            return path.rlike(entry[3:])
        if entry.startswith("content-type:"):
            return F.lower(content_type).startswith(entry.removeprefix("content-type:").lower())
        return path.rlike(glob_pattern(entry))

    out = F.lit(default)
    for name, entries in reversed(list(groups.items())):
        if name != default and entries:
            out = F.when(reduce(lambda a, b: a | b, [F.coalesce(hit(e), F.lit(False)) for e in entries]), name).otherwise(out)
    return out


def admitted(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is to be looked at: some glob of ``include`` matches, if there is any, and none of ``exclude``."""
    some = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))
    return (some(include) if include else F.lit(True)) & ~some(exclude)


def glob_pattern(glob: str, across: bool = False, ignore_case: bool = False) -> str:
    """A regular expression for a glob: * stays within a path segment unless ``across``, ** never does (as a whole
    segment it may be empty), ? is one character, {a,b} a choice, which may nest; [abc] and [!abc] are sets of characters."""
    out, i, depth = "", 0, 0
    star, one = (".*", ".") if across else ("[^/]*", "[^/]")
    while i < len(glob):
        c = glob[i]
        if glob.startswith("/**/", i):
            out, i = out + "/(?:.*/)?", i + 4
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" if inner[0] == "!" else "") + inner.lstrip("!").replace("\\", "\\\\").replace("[", "\\[") + "]", end + 1
            continue
        if c == "\\" and i + 1 < len(glob):
            out, i = out + "\\" + glob[i + 1], i + 2
            continue
        if c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += star if c == "*" else one if c == "?" else "\\" + c if c in ".+^$()[]{}|\\" else c
        i += 1
    return ("(?i)" if ignore_case else "") + f"^{out}$"
