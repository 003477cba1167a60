"""Captured files: robots.txt, sitemaps, URL lists, feeds."""

from __future__ import annotations

import gzip
import re
import zlib
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions import urls as U
from pagesift.sources.scratch import cut

#: The most bytes of a sitemap, the names tried where none is told, and what a sitemap's name looks like.
MOST_BYTES = 50 << 20
CANDIDATES = ("/sitemap.xml", "/sitemap.txt", "/sitemap_index.xml")
SITEMAP_NAME = r"(?i)sitemap(?:_index)?\.(?:xml|txt)(?:\.gz)?$"


def seeds(spark, urls: list[str]) -> DataFrame:
    """(url): the URLs a crawl begins with, each once."""
    return spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string")


def together(*lists: DataFrame) -> DataFrame:
    """(url): the URLs of several sources as one set."""
    out = lists[0].select("url")
    for more in lists[1:]:
        out = out.unionByName(more.select("url"))
    return out.distinct()


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url): one per line, without comments and empty lines."""
    url = F.trim(F.regexp_replace(column, r"(^|\s)#.*$", ""))
    return lines.select(url.alias("url")).where("url <> ''").distinct()


def robots_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, field, value) of robots.txt texts: names lower-case, comments dropped."""
    rows = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    return rows.select(key, "line", F.lower(F.trim(F.split_part(clean, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace(clean, "^[^:]*:", "")).alias("value")).where("field <> '' AND value <> field")


def robots_policy(files: DataFrame, key: str, status: str, text: str) -> DataFrame:
    """``files`` with the text that holds: of a 2xx answer its own, of a 4xx none, and all is disallowed for a 5xx or no answer."""
    held = F.when(F.col(status).between(200, 299), F.col(text)).when(F.col(status).between(400, 499), "").otherwise("User-agent: *\nDisallow: /")
    return files.withColumn(text, held)


def robots_settings(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, agent, field, value): sitemap lines (agent null), and for each agent the crawl delays and content signals of its group."""
    order = Window.partitionBy(key).orderBy("line")
    lines = robots_lines(files, key, text)
    agent = F.col("field") == "user-agent"
    starts = (agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))).cast("int")
    grouped = lines.withColumn("g", F.sum(starts).over(order))
    agents = grouped.where(agent).select(key, "g", F.lower("value").alias("agent")).distinct()
    told = grouped.where(F.col("field").isin("crawl-delay", "content-signal")).join(agents, [key, "g"], "left")
    delays = told.where((F.col("field") == "crawl-delay") & F.col("agent").isNotNull() & F.col("value").try_cast("double").isNotNull())
    pairs = F.explode(F.filter(F.transform(F.split("value", ","), lambda p: F.lower(F.regexp_replace(F.trim(p), r"\s*=\s*", "="))), lambda p: ~p.startswith("=") & (p != "")))
    signals = told.where(F.col("field") == "content-signal").select(key, "line", "agent", "field", pairs.alias("value"))
    maps = grouped.where(F.col("field") == "sitemap").select(key, "line", F.lit(None).cast("string").alias("agent"), "field", "value")
    return maps.unionByName(delays.select(key, "line", "agent", "field", "value")).unionByName(signals)


def robots_groups(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, agent, allow, rule, line): one row per agent and rule. A group begins with the first agent line after a rule."""
    order = Window.partitionBy(key).orderBy("line")
    lines = robots_lines(files, key, text).where(F.col("field").isin("user-agent", "allow", "disallow"))
    agent = F.col("field") == "user-agent"
    starts = (agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))).cast("int")
    grouped = lines.withColumn("g", F.sum(starts).over(order))
    agents = grouped.where(agent).select(key, "g", F.lower("value").alias("agent")).distinct()
    rules = grouped.where(~agent).select(key, "g", (F.col("field") == "allow").alias("allow"), F.col("value").alias("rule"), "line")
    return agents.join(rules, [key, "g"]).select(key, "agent", "allow", "rule", "line")


def allowed(paths: DataFrame, groups: DataFrame, key: str, path: str, agent: str) -> DataFrame:
    """``paths`` with allowed: the longest matching rule of the agent's groups, or else of *, decides; allow wins a tie; without a match all is allowed."""
    mine = groups.where(F.col("agent") == agent.lower()).select(key).distinct().withColumn("named", F.lit(True))
    chosen = groups.join(mine, key, "left").where((F.col("named") & (F.col("agent") == agent.lower())) | (F.col("named").isNull() & (F.col("agent") == "*"))).where("rule <> ''")
    # Quoting leaves * and $ alone; they are then put into the expression.
    pattern = F.concat(F.lit(r"^\Q"), F.regexp_replace(F.regexp_replace("rule", r"\*", r"\\E.*\\Q"), r"\$$", r"\\E\$\\Q"), F.lit(r"\E"))
    hits = paths.join(chosen.withColumn("pattern", pattern), key).where(F.expr(f"{path} rlike pattern"))
    best = hits.groupBy(key, path).agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("verdict"))
    return paths.join(best, [key, path], "left").select(*paths.columns, F.coalesce("verdict", F.lit(True)).alias("allowed"))


def sitemap_entries(files: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, loc, lastmod, changefreq, priority) of sitemap texts: url elements by their tags; unclosed ones are skipped."""
    of = lambda e, tag: F.nullif(F.trim(F.regexp_extract(e, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    rows = files.select(key, F.explode(F.regexp_extract_all(xml, F.lit(r"(?is)<url\b[^>]*>.*?</url>"), 0)).alias("e"))
    plain: Column = F.regexp_replace(of(F.col("e"), "loc"), "&amp;", "&")
    return rows.select(key, plain.alias("loc"), of(F.col("e"), "lastmod").alias("lastmod"), F.lower(of(F.col("e"), "changefreq")).alias("changefreq"), of(F.col("e"), "priority").try_cast("double").alias("priority")).where("loc IS NOT NULL")


_ENTRY = "struct<kind: string, loc: string, lastmod: string, changefreq: string, priority: double, alternates: array<struct<lang: string, href: string>>, images: array<string>, videos: array<string>>"
_ENTRY_TYPE = pa.struct([("kind", pa.string()), ("loc", pa.string()), ("lastmod", pa.string()), ("changefreq", pa.string()), ("priority", pa.float64()), ("alternates", pa.list_(pa.struct([("lang", pa.string()), ("href", pa.string())]))), ("images", pa.list_(pa.string())), ("videos", pa.list_(pa.string()))])


def _tag(name: str) -> re.Pattern:
    return re.compile(rf"<{name}\b[^>]*>(.*?)</{name}\s*>", re.I | re.S)


_PARTS = {n: _tag(n) for n in ("url", "sitemap", "loc", "lastmod", "changefreq", "priority", "image:image", "image:loc", "video:video", "video:content_loc", "video:player_loc")}
_ALTERNATE = re.compile(r"<xhtml:link\b([^>]*)/?>", re.I)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _plain(text: str) -> str:
    m = re.match(r"\s*<!\[CDATA\[(.*?)\]\]>\s*$", text, re.S)
    return (m[1] if m else unescape(text)).strip()


def _first(name: str, text: str) -> str | None:
    m = _PARTS[name].search(text)
    return _plain(m[1]) or None if m else None


def unpacked(body: bytes, most: int = MOST_BYTES) -> bytes | None:
    """All members of a gzip file; None where they are more than ``most`` bytes."""
    out, size = [], 0
    while body[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(body, most - size + 1))
        size += len(out[-1])
        if size > most:
            return None
        if not member.eof:
            raise zlib.error("the file ends too early")
        body = member.unused_data
    return b"".join(out)


def sitemap_file(body: bytes | None, content_type: str | None, url: str | None) -> dict:
    """One file: its entries and what is wrong with it. A gzip file is known by its first bytes, a text one by its type or name."""
    kind = (content_type or "").split(";")[0].strip().lower()
    if body is None or kind == "text/html":
        return {"entries": [], "error": "no sitemap" if kind == "text/html" else "no answer"}
    try:
        if body[:2] == b"\x1f\x8b":
            body = unpacked(body)
            if body is None:
                return {"entries": [], "error": f"unpacks to more than {MOST_BYTES} bytes"}
        text = body.decode("utf-8", "replace")
    except (zlib.error, gzip.BadGzipFile) as e:
        return {"entries": [], "error": f"does not unpack: {e}"}
    if kind == "text/plain" or re.sub(r"\.gz$", "", re.split("[?#]", url or "")[0]).endswith(".txt"):
        entries = [{"kind": "url", "loc": line.strip()} for line in text.splitlines() if re.match(r"\s*[a-z][a-z0-9+.-]*://\S", line, re.I)]
        return {"entries": entries, "error": None if entries else "names no URL"}
    entries = [{"kind": "sitemap", "loc": loc} for m in _PARTS["sitemap"].finditer(text) if (loc := _first("loc", m[1]))]
    for m in _PARTS["url"].finditer(text):
        e = m[1]
        bare = re.sub(r"(?is)<(image|video):(image|video)\b.*?</\1:\2\s*>", "", e)
        if not (loc := _first("loc", bare)):
            continue
        links = [{k.lower(): x or y for k, x, y in _ATTRIBUTE.findall(a)} for a in _ALTERNATE.findall(e)]
        alternates = [{"lang": a["hreflang"], "href": unescape(a["href"])} for a in links if a.get("rel") == "alternate" and "hreflang" in a and "href" in a]
        images = [_plain(x) for i in _PARTS["image:image"].findall(e) for x in _PARTS["image:loc"].findall(i)]
        videos = [_plain(x) for v in _PARTS["video:video"].findall(e) for tag in ("video:content_loc", "video:player_loc") for x in _PARTS[tag].findall(v)]
        priority = _first("priority", bare) or ""
        entries.append({
            "kind": "url", "loc": loc, "lastmod": _first("lastmod", bare), "changefreq": (_first("changefreq", bare) or "").lower() or None,
            "priority": float(priority) if re.fullmatch(r"\d*\.?\d+", priority) else None, "alternates": alternates, "images": images, "videos": videos,
        })
    return {"entries": entries, "error": None if entries else "names no URL"}


def sitemap_files(files: DataFrame, url: str = "url", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """(url, entries, error) of captured sitemaps, bodies as bytes: XML with alternates, images and videos, text lists, gzip files, and indexes, whose entries have the kind sitemap."""

    @F.arrow_udf(f"struct<entries: array<{_ENTRY}>, error: string>")
    def read(bodies: pa.Array, kinds: pa.Array, urls: pa.Array) -> pa.Array:
        rows = [sitemap_file(b, k, u) for b, k, u in zip(bodies.to_pylist(), kinds.to_pylist(), urls.to_pylist())]
        return pa.array(rows, pa.struct([("entries", pa.list_(_ENTRY_TYPE)), ("error", pa.string())]))

    return files.select(F.col(url).alias("url"), read(F.col(body).cast("binary"), F.col(content_type).cast("string"), F.col(url)).alias("s")).select("url", "s.entries", "s.error")


def read_sitemaps(start: DataFrame, files: DataFrame) -> DataFrame:
    """(sitemap, kind, loc, ...): the entries of the files that ``start`` (url) names and of those nested in them on the same host.

    ``files`` are captured ones, as for ``sitemap_files``. Each is read once, level by level, until a level names no new file."""
    parsed = cut(sitemap_files(files))
    seen = cut(start.select("url").distinct())
    frontier, out = seen, None
    while True:
        rows = parsed.join(frontier, "url").select(F.col("url").alias("sitemap"), F.explode("entries").alias("e")).select("sitemap", "e.*")
        out = rows if out is None else out.unionByName(rows)
        nested = rows.where((F.col("kind") == "sitemap") & (U.host(F.col("loc")) == U.host(F.col("sitemap")))).select(F.col("loc").alias("url")).distinct()
        frontier = cut(nested.join(seen, "url", "left_anti"))
        if not frontier.limit(1).count():
            return out.where("kind = 'url'")
        seen = cut(seen.unionByName(frontier))


def discovered_sitemaps(origins: DataFrame, listed: DataFrame, named: DataFrame, answers: DataFrame) -> DataFrame:
    """(origin, url): sitemaps to read: those robots.txt lists, the seeds that name one, and where no seed does, the usual names that answer 2xx.

    ``origins`` is (origin), ``listed`` (origin, url), ``named`` (url) and ``answers`` (url, status)."""
    seeds_named = named.where(F.col("url").rlike(SITEMAP_NAME)).select(U.origin(F.col("url")).alias("origin"), "url")
    tried = origins.join(seeds_named.select("origin").distinct(), "origin", "left_anti").select("origin", F.explode(F.array(*[F.concat(F.col("origin"), F.lit(c)) for c in CANDIDATES])).alias("url"))
    answering = tried.join(answers.where("status BETWEEN 200 AND 299").select("url"), "url", "left_semi").select("origin", "url")
    return listed.select("origin", "url").unionByName(seeds_named).unionByName(answering).distinct()


def feed_items(files: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, position, title, link, id) of RSS items and Atom entries."""
    rows = files.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)>"), 0)).alias("position", "e"))
    of = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?is)<{tag}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)), F.lit(""))
    atom = F.nullif(F.regexp_extract("e", r"""(?is)<link\b[^>]*href=["']([^"']*)""", 1), F.lit(""))
    return rows.select(key, "position", of("title").alias("title"), F.coalesce(of("link"), atom).alias("link"), F.coalesce(of("guid"), of("id")).alias("id"))
