"""What callers add: extractors of facts, makers of rules, presets, formatters and sources of URLs, kept under names that may not clash.

An extractor runs only if a rule reads its fact: ``with_facts`` adds the columns that the rules of a run ask for and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from pagesift.operators.caching import misses, newest
from pagesift.operators.rules import KEYWORDS, Rule
from pagesift.operators.rulesets import ConfigError
from pagesift.sources.scratch import cut


@dataclass(frozen=True)
class PageExtractor:
    """Adds the column ``id`` to a table of pages: ``extract`` gets the columns named in ``inputs`` and gives a column (a built-in
    expression, or an Arrow function). ``version`` is part of the key under which results are kept."""

    id: str
    extract: Callable[..., Column]
    inputs: tuple[str, ...]
    version: int = 1


@dataclass(frozen=True)
class ResourceExtractor:
    """The same for resources whose content type begins with ``type``; others have null."""

    id: str
    type: str
    extract: Callable[..., Column]
    inputs: tuple[str, ...]
    version: int = 1


@dataclass(frozen=True)
class SiteExtractor:
    """Facts of each origin or host: ``extract`` gets the table of pages and gives a table with the column ``per`` (origin or host)
    and one column named ``id``."""

    id: str
    per: str
    extract: Callable[[DataFrame], DataFrame]
    version: int = 1


def table_function(id: str, per: str, handler: type, returns: str, gather: Callable[[DataFrame], DataFrame], inputs: tuple[str, ...], version: int = 1) -> SiteExtractor:
    """A site extractor by a Python table function: ``handler.eval`` gets the ``inputs`` of one subject and yields its facts,
    ``returns`` being their DDL. ``gather`` makes the table of subjects (``per``, inputs) from the pages, by aggregates, so that no
    subject's pages come together in one task. A subject for which nothing is yielded has null; of several rows one counts."""

    def extract(pages: DataFrame) -> DataFrame:
        subjects = gather(pages)
        called = F.udtf(handler, returnType=returns)(*[F.col(c).outer() for c in inputs])
        names = StructType.fromDDL(returns).fieldNames()
        told = subjects.lateralJoin(called).groupBy(per).agg(F.first(F.struct(*names)).alias(id))
        return subjects.select(per).distinct().join(told, per, "left").select(per, id)

    return SiteExtractor(id, per, extract, version)


def kept_for(extractor: SiteExtractor, entries: str, seconds: int, now: Column | None = None) -> SiteExtractor:
    """The extractor with its results kept under ``entries``, a folder all executors see: subjects whose entry, by the extractor's
    id and version, is younger than ``seconds`` are not extracted again. Pages of other subjects aren't given to the extractor."""

    def extract(pages: DataFrame) -> DataFrame:
        spark, at, per = pages.sparkSession, now if now is not None else F.current_timestamp(), extractor.per
        asked = pages.select(per).distinct()
        shape = extractor.extract(pages.limit(0)).schema
        schema = StructType([*shape.fields, StructField("version", LongType()), StructField("stored_at", TimestampType())])
        folder = f"{entries}/{extractor.id}"
        spark.createDataFrame([], schema).write.mode("append").parquet(folder)  # so that there is one to read
        old = spark.read.schema(schema).parquet(folder).where(F.col("version") == extractor.version)
        lost = misses(asked, old, per, at, seconds)
        fresh = extractor.extract(pages.join(lost, per, "left_semi")).select(*shape.fieldNames())
        cut(fresh.withColumns({"version": F.lit(extractor.version).cast("long"), "stored_at": at})).write.mode("append").parquet(folder)
        every = spark.read.schema(schema).parquet(folder).where(F.col("version") == extractor.version)
        return newest(every.select(per, extractor.id, "stored_at"), [per], "stored_at").join(asked, per, "left_semi").select(per, extractor.id)

    return replace(extractor, extract=extract)


@dataclass
class Extensions:
    pages: dict[str, PageExtractor] = field(default_factory=dict)
    resources: dict[str, ResourceExtractor] = field(default_factory=dict)
    sites: dict[str, SiteExtractor] = field(default_factory=dict)
    makers: dict[str, Callable[..., Rule]] = field(default_factory=dict)
    presets: dict[str, Mapping[str, Any]] = field(default_factory=dict)
    formatters: dict[str, Callable[[DataFrame, str], None]] = field(default_factory=dict)
    sources: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    settings: dict[str, Mapping[str, Any]] = field(default_factory=dict)
    reserved: frozenset[str] = frozenset({"url", "http", "html", "robots", "group", "site", "sitemap", "graph", "crawl", "tls", "resources"})

    def _add(self, kind: str, name: str, value: Any) -> None:
        table = getattr(self, kind)
        taken = kind in ("pages", "resources", "sites") and (name in self.reserved or any(name in getattr(self, k) for k in ("pages", "resources", "sites")))
        if taken or name in table:
            raise ConfigError(f"{kind}: the name {name} is taken")
        if not name or any(c in name for c in ". \t"):
            raise ConfigError(f"{kind}: no name: {name!r}")
        table[name] = value

    def page_extractor(self, e: PageExtractor) -> None:
        self._add("pages", e.id, e)

    def resource_extractor(self, e: ResourceExtractor) -> None:
        self._add("resources", e.id, e)

    def site_extractor(self, e: SiteExtractor) -> None:
        if e.per not in ("origin", "host"):
            raise ConfigError(f"{e.id}: per is origin or host")
        self._add("sites", e.id, e)

    def rule_maker(self, name: str, make: Callable[..., Rule]) -> None:
        self._add("makers", name, make)

    def preset(self, name: str, rules: Mapping[str, Any]) -> None:
        self._add("presets", name, rules)

    def formatter(self, name: str, write: Callable[[DataFrame, str], None]) -> None:
        self._add("formatters", name, write)

    def source(self, name: str, read: Callable[..., DataFrame]) -> None:
        self._add("sources", name, read)

    def setting(self, name: str, schema: Mapping[str, Any]) -> None:
        """``schema`` has default and keywords as rules have them: type, enum, minimum, maximum, pattern."""
        if unknown := set(schema) - KEYWORDS - {"default", "description"}:
            raise ConfigError(f"{name}: keywords not known: {sorted(unknown)}")
        self._add("settings", name, schema)

    def configured(self, given: Mapping[str, Any]) -> dict[str, Any]:
        """Every setting with the given value or its default; unknown and unfit ones are refused."""
        import re

        kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
        if unknown := set(given) - set(self.settings):
            raise ConfigError(f"settings not known: {sorted(unknown)}")
        out = {}
        for name, schema in self.settings.items():
            value = given.get(name, schema.get("default"))
            kind = schema.get("type")
            wrong = kind and (not isinstance(value, kinds[kind]) or (isinstance(value, bool) and kind in ("integer", "number")))
            wrong = wrong or ("enum" in schema and value not in schema["enum"]) or ("minimum" in schema and value < schema["minimum"]) or ("maximum" in schema and value > schema["maximum"])
            wrong = wrong or ("pattern" in schema and not re.search(schema["pattern"], value))
            if name in given and wrong:
                raise ConfigError(f"{name}: {value!r} does not fit {dict(schema)}")
            out[name] = value
        return out

    def wanted(self, rules: Iterable[Rule]) -> set[str]:
        """Names of the extractors whose facts some rule reads, as its fact or a guard."""
        paths = [p for r in rules for p in (r.fact, *r.when)]
        roots = {p.split(".")[0] for p in paths} | {p.split(".")[3] for p in paths if p.startswith(("site.origins.*.", "site.hosts.*."))}
        return roots & {*self.pages, *self.resources, *self.sites}

    def needed(self, rules: Iterable[Rule]) -> list[PageExtractor]:
        """The page extractors that the rules read."""
        names = self.wanted(rules)
        return [e for n, e in self.pages.items() if n in names]

    def rule(self, rule_id: str, spec: Mapping[str, Any]) -> Rule:
        """The rule that a specification's ``maker`` makes of its ``options``, under the id, level and guards given there."""
        make = self.makers.get(spec["maker"])
        if make is None:
            raise ConfigError(f"{rule_id}: no maker is named {spec['maker']}")
        made = make(**spec.get("options", {}))
        return replace(made, id=rule_id, severity=spec.get("severity") or made.severity, when={**made.when, **spec.get("when", {})})

    def write(self, name: str, findings: DataFrame, path: str) -> None:
        """Findings in the form of a registered formatter."""
        if name not in self.formatters:
            raise ConfigError(f"no formatter is named {name}; there are {sorted(self.formatters)}")
        self.formatters[name](findings, path)

    def urls(self, name: str, *args: Any, **options: Any) -> DataFrame:
        """The URLs of a registered source."""
        if name not in self.sources:
            raise ConfigError(f"no source is named {name}; there are {sorted(self.sources)}")
        return self.sources[name](*args, **options)

    def with_facts(self, pages: DataFrame, rules: Iterable[Rule]) -> DataFrame:
        """``pages`` with the columns of the page extractors that the rules read."""
        names = self.wanted(rules)
        return pages.withColumns({n: e.extract(*[F.col(c) for c in e.inputs]) for n, e in self.pages.items() if n in names})

    def with_resource_facts(self, resources: DataFrame, rules: Iterable[Rule], content_type: str = "type") -> DataFrame:
        names = self.wanted(rules)
        hit = lambda e: F.lower(F.col(content_type)).startswith(e.type.lower())
        return resources.withColumns({n: F.when(hit(e), e.extract(*[F.col(c) for c in e.inputs])) for n, e in self.resources.items() if n in names})

    def subjects(self, pages: DataFrame, rules: Iterable[Rule], per: str, linked: DataFrame | None = None) -> DataFrame:
        """(name, linked, one column for each site extractor per origin or host that the rules read), for ``rules.subject_findings``.

        ``pages`` has the column ``per``; ``linked`` (name) are further hosts that the site links to."""
        names = self.wanted(rules)
        own = pages.select(F.col(per).alias("name")).distinct().withColumn("linked", F.lit(False))
        if linked is not None:
            own = own.unionByName(linked.select("name").distinct().join(own, "name", "left_anti").withColumn("linked", F.lit(True)))
        for name, e in self.sites.items():
            if name in names and e.per == per:
                own = own.join(e.extract(pages).select(F.col(per).alias("name"), F.col(name)), "name", "left")
        return own
