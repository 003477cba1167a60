"""Structured data of pages: nodes of JSON-LD, microdata and RDFa at any depth, what they refer to, and what they should say."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import markup
from pagesift.functions.weburl import resolve, resolved
from pagesift.sources.scratch import cut

NODES = "array<struct<path: string, id: string, types: array<string>, name: string, defines: boolean, crumbs: array<string>, properties: map<string, array<string>>>>"
_TYPE = pa.list_(pa.struct([("path", pa.string()), ("id", pa.string()), ("types", pa.list_(pa.string())), ("name", pa.string()), ("defines", pa.bool_()), ("crumbs", pa.list_(pa.string())), ("properties", pa.map_(pa.string(), pa.list_(pa.string())))]))

_KINDS = {"path": "string", "id": "string", "types": "array<string>", "name": "string", "defines": "boolean", "crumbs": "array<string>", "properties": "map<string, array<string>>"}

# Fixed values, from search engines' pages on rich results and from schema.org: properties that a type's results ask for,
# types about the page they stand on, and date properties whose names don't say so.
REQUIRED = {
    "BreadcrumbList": ("itemListElement",), "Course": ("name", "description"), "Dataset": ("name", "description"), "Event": ("name", "startDate", "location"), "FAQPage": ("mainEntity",), "JobPosting": ("title", "description", "datePosted", "hiringOrganization"),
    "LocalBusiness": ("name", "address"), "Product": ("name",), "Recipe": ("name", "image"), "Review": ("author", "itemReviewed", "reviewRating"), "VideoObject": ("name", "thumbnailUrl", "uploadDate"),
}
PAGES = ("WebPage", "AboutPage", "CheckoutPage", "CollectionPage", "ContactPage", "FAQPage", "ItemPage", "MedicalWebPage", "ProfilePage", "QAPage", "SearchResultsPage")
ARTICLES = ("Article", "BlogPosting", "LiveBlogPosting", "NewsArticle", "Report", "SatiricalArticle", "ScholarlyArticle", "SocialMediaPosting", "TechArticle")
DATES = ("uploadDate", "validFrom", "validThrough", "expires", "priceValidUntil", "availabilityStarts", "availabilityEnds")
ISO_DATE = r"^[0-9]{4}(-[0-9]{2}){2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def _absolute(node_id: str, base: str) -> str:
    return node_id if node_id.startswith("_:") else resolve(base, node_id) or node_id


def _types(node: dict) -> list[str]:
    raw = node.get("@type")
    return [re.sub(r"^(https?://schema\.org/|schema:)", "", t) for t in (raw if isinstance(raw, list) else [raw]) if isinstance(t, str)]


def _said(value) -> list[str]:
    """The values of a property as texts: of a node its id, URL or name; null and empty texts are none."""
    out = []
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, dict):
            v = next((v[k] for k in ("@id", "url", "name") if isinstance(v.get(k), str)), "{}")
        if v is not None and v != "":
            out.append(v if isinstance(v, str) else json.dumps(v))
    return out


def _address(item, base: str) -> str | None:
    """The URL that a breadcrumb's item names: itself, its id or its url."""
    if isinstance(item, dict):
        item = item.get("@id") or item.get("url")
    return _absolute(item, base) if isinstance(item, str) and item else None


def walk(value, base: str, properties: bool = True) -> list[dict]:
    """All nodes of a JSON-LD value, with the path that leads to each; contexts are not looked into. Depth is not limited."""
    found, todo = [], [("", value)]
    while todo:
        path, x = todo.pop()
        below = lambda k: f"{path}.{k}" if path else str(k)
        if isinstance(x, list):
            todo += [(below(i), e) for i, e in reversed(list(enumerate(x)))]
        elif isinstance(x, dict):
            node_id, types = x.get("@id"), _types(x)
            crumbs = []
            if "BreadcrumbList" in types:
                items = x.get("itemListElement")
                crumbs = [u for e in (items if isinstance(items, list) else [items]) if isinstance(e, dict) and (u := _address(e.get("item"), base))]
            found.append({
                "path": path, "id": _absolute(node_id, base) if isinstance(node_id, str) else None, "types": types, "name": x["name"] if isinstance(x.get("name"), str) else None,
                "defines": isinstance(node_id, str) and any(k not in ("@id", "@context") for k in x), "crumbs": list(dict.fromkeys(crumbs)), "properties": [(k, _said(v)) for k, v in x.items() if not k.startswith("@")] if properties else [],
            })
            todo += [(below(k), v) for k, v in reversed(list(x.items())) if k != "@context" and isinstance(v, (dict, list))]
    return found


def ids(value, base: str) -> list[dict]:
    """The id of each node of ``walk`` and whether it is defined there, and nothing else."""
    found, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += x[::-1]
        elif isinstance(x, dict):
            named = isinstance(node_id := x.get("@id"), str)
            found.append({"id": _absolute(node_id, base) if named else None, "defines": named and len(x) > 1 + ("@context" in x)})
            todo += [v for k, v in reversed(x.items()) if k != "@context" and isinstance(v, (dict, list))]
    return found


def nodes(blocks: Column, url: Column, only: Sequence[str] = ()) -> Column:
    """array of nodes of a page's JSON-LD texts; a text that is no JSON has none. Null blocks give null. With ``only``
    nodes have no more than these fields, and of nodes that are alike in them a page gives one."""
    kind = pa.list_(pa.struct([f for f in _TYPE.value_type if not only or f.name in only]))
    fields = [f.name for f in kind.value_type]
    look = ids if only and set(only) <= {"id", "defines"} else lambda v, base: walk(v, base, not only or "properties" in only)
    ddl = NODES if not only else "array<struct<" + ", ".join(f"{n}: {_KINDS[n]}" for n in fields) + ">>"

    def read(texts, base):
        values = []
        for t in texts:
            try:
                values.append(json.loads(t))
            except (TypeError, ValueError, RecursionError):  # the last of what is nested beyond reading
                continue
        found = [n for v in values for n in look(v, base) if not (isinstance(v, dict) and "@error" in v)]
        if look is ids:
            return list({(n["id"], n["defines"]) if len(fields) == 2 else n[fields[0]]: n for n in found}.values())
        return list({repr(t): t for n in found for t in [{f: n[f] for f in fields}]}.values()) if only else found

    @F.arrow_udf(ddl)
    def run(lists: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.array([None if b is None or u is None else read(b, u) for b, u in zip(lists.to_pylist(), urls.to_pylist())], kind)

    return run(blocks, url)


def page_nodes(pages: DataFrame, blocks: str = "jsonld", url: str = "href", only: Sequence[str] = ()) -> DataFrame:
    """(href, path, id, types, name, defines, crumbs, properties): one row for each node; with ``only`` no more than these fields, alike nodes once."""
    return pages.select(F.col(url).alias("href"), F.explode(nodes(F.col(blocks), F.col(url), only)).alias("n")).select("href", "n.*")


def all_blocks(jsonld: Column, html: Column, url: Column) -> Column:
    """The texts of a page's nodes in all three syntaxes, for ``nodes``."""
    none = F.array().cast("array<string>")
    marked = markup.items(html, url)
    return F.concat(F.coalesce(jsonld, none), F.coalesce(marked["microdata"], none), F.coalesce(marked["rdfa"], none))


def _top(path: str) -> Column:
    """Nodes that stand for themselves: a block, an entry of a list of them, or a member of @graph."""
    return F.col(path).rlike(r"^(\d+)?$|^(\d+\.)?@graph(\.\d+)?$")


def missing_properties(found: DataFrame, required: Mapping[str, Sequence[str]] = REQUIRED) -> DataFrame:
    """(href, path, type, missing): nodes that stand for themselves and lack what results of their type ask for."""
    asked = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    typed = found.where(_top("path")).select("href", "path", "properties", F.explode("types").alias("type")).withColumn("asked", F.try_element_at(asked, "type")).where("asked IS NOT NULL")
    absent = F.filter("asked", lambda p: F.coalesce(F.size(F.try_element_at("properties", p)), F.lit(0)) < 1)
    return typed.select("href", "path", "type", absent.alias("missing")).where("size(missing) > 0")


def invalid_dates(found: DataFrame) -> DataFrame:
    """(href, path, property, value): values of date properties that are no ISO 8601 date or time."""
    said = found.select("href", "path", F.explode("properties").alias("property", "values"))
    named = F.col("property").startswith("date") | F.col("property").endswith("Date") | F.col("property").isin(*DATES)
    values = said.where(named).select("href", "path", "property", F.explode("values").alias("value"))
    return values.where(~F.col("value").rlike(ISO_DATE))


def superseded(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(href, kind, term, successor): types, properties and enumeration values of schema.org that ``terms`` (term, successor) says were replaced."""
    iri = r"^https?://schema\.org/(\w+)$"
    told = lambda kind, names: found.select("href", F.lit(kind).alias("kind"), F.explode(names).alias("term"))
    values = F.transform(F.filter(F.flatten(F.map_values("properties")), lambda v: v.rlike(iri)), lambda v: F.regexp_extract(v, iri, 1))
    used = told("type", F.col("types")).unionByName(told("property", F.map_keys("properties"))).unionByName(told("value", values))
    return used.distinct().join(terms, "term").select("href", "kind", "term", "successor")


def claims_apart(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(href, path, fault): nodes about the page itself whose url isn't the canonical one, or whose name isn't in a title
    nor a title in it. ``pages`` is (href, canonical, title, og_title)."""
    about = found.where(_top("path") & F.arrays_overlap("types", F.array(*map(F.lit, PAGES + ARTICLES)))).join(pages, "href")
    at = F.coalesce(resolved(F.col("href"), F.coalesce("canonical", "href")), F.col("href"))
    prop = lambda n: F.coalesce(F.try_element_at("properties", F.lit(n)), F.array().cast("array<string>"))
    urls = about.select("href", "path", at.alias("at"), F.explode(F.concat(prop("url"), prop("mainEntityOfPage"))).alias("url")).withColumn("url", resolved(F.col("href"), F.col("url")))
    other = urls.where("url <> at").select("href", "path", F.concat(F.lit("names "), "url").alias("fault"))
    folded = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))
    name = folded(F.coalesce(F.get(prop("headline"), F.lit(0)), F.get(prop("name"), F.lit(0))))
    titles = F.transform(F.array_compact(F.array("title", "og_title")), folded)
    apart = F.forall(titles, lambda t: ~F.contains(t, F.col("called")) & ~F.contains(F.col("called"), t))
    named = about.withColumns({"called": name, "titles": titles}).where(F.col("called").isNotNull() & (F.size("titles") > 0) & apart)
    return other.unionByName(named.select("href", "path", F.concat(F.lit("is called "), "called").alias("fault")))


def dangling(found: DataFrame) -> DataFrame:
    """(id, pages): references to blank nodes, or into known pages, that neither the page that refers nor the page that is
    referred to defines; with the number of pages that refer. ``found`` are the nodes of all pages."""
    # One row for each page and id, as far as a page has any; texts are parsed once. The sides of the join grow with the pages, so none is broadcast.
    told = cut(found.groupBy("href", "id").agg(F.max("defines").alias("defines")))
    blank = F.col("id").startswith("_:")
    open_refs = told.where("id IS NOT NULL AND NOT defines").select("id", "href", blank.alias("blank"))
    own = open_refs.where("blank").groupBy("id").agg(F.count("*").alias("pages"))
    # A page is what its ids begin with: of what pages define only ids of their own can be meant, and no more than these are dealt. Hot targets are counted first.
    at = F.when(F.contains("id", F.lit("#")), F.split_part("id", F.lit("#"), F.lit(1)))
    away = open_refs.where("NOT blank").groupBy("id").agg(F.count("*").alias("pages")).withColumn("at", at)
    there = told.where(F.col("defines") & (at == F.col("href"))).select("id").hint("merge")
    known = told.select(F.col("href").alias("at")).distinct().hint("merge")
    lost = away.where("at IS NOT NULL").join(there, "id", "left_anti").join(known, "at", "left_semi")
    return own.unionByName(lost.select("id", "pages"))


def unreachable_crumbs(found: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(url, fault, pages): breadcrumb targets that redirect, or answer outside 2xx; pages is (href, status), redirects (from, to). Targets that weren't fetched say nothing."""
    named = found.select("href", F.explode("crumbs").alias("url")).distinct()
    moved = redirects.select(F.col("from").alias("url"), F.col("to").alias("landing")).dropDuplicates(["url"])
    asked = named.join(pages.select(F.col("href").alias("url"), "status"), "url", "left").join(moved, "url", "left")
    fault = F.when(F.col("landing").isNotNull(), F.concat(F.lit("redirects to "), "landing")).when(~F.col("status").between(200, 299), F.concat(F.lit("answers "), F.col("status").cast("string")))
    return asked.withColumn("fault", fault).where("fault IS NOT NULL").groupBy("url", "fault").agg(F.count_distinct("href").alias("pages"))
