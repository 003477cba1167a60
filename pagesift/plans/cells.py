"""Queries that give the cells of whole tables to the operators over texts, paths, hosts and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions import strings as S
from pagesift.functions import urls as U
from pagesift.functions import weburl as W
from pagesift.operators import site as O
from pagesift.plans.pages import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(f"SELECT doc_id, CASE WHEN length(text) > {S.WHOLE} THEN substr(text, 1, {S.HEAD}) || '…' || right(text, {S.TAIL}) ELSE text END AS shown FROM documents")
def elided_documents(spark, sf_dir):
    """Texts as messages show them."""
    return read(spark, sf_dir, "documents").select("doc_id", S.elided(F.col("text")).alias("shown"))


_HOST = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]+$', '')"
_ORIGIN = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'))"


@query(f"SELECT page_id, regexp_extract({_HOST.format('url')}, '[^.]+[.][^.]+$') AS domain FROM pages")
def domains_of_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", W.registrable_domain(U.host(F.col("url"))).alias("domain"))


@query(
    f"""WITH p AS (SELECT a.page_id, a.url AS x, b.url AS y FROM pages a JOIN pages b ON b.page_id = a.page_id + 7)
SELECT page_id, {_ORIGIN.format("x")} = {_ORIGIN.format("y")} AS origin, {_HOST.format("x")} = {_HOST.format("y")} AS host,
       regexp_extract({_HOST.format("x")}, '[^.]+[.][^.]+$') = regexp_extract({_HOST.format("y")}, '[^.]+[.][^.]+$') AS domain FROM p"""
)
def scopes_of_pages(spark, sf_dir):
    """Whether each page shares its origin, host and domain with the seventh after it."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    later = pages.select((F.col("page_id") - 7).alias("page_id"), F.col("url").alias("other"))
    return pages.join(later, "page_id").select("page_id", *[O.same_scope(F.col("url"), F.col("other"), s).alias(s) for s in ("origin", "host", "domain")])


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN regexp_matches(substr(md5(p_partkey::VARCHAR), 1, 8), '[0-9]') WHEN 1 THEN true WHEN 2 THEN regexp_matches(substr(md5(p_partkey::VARCHAR), 1, 6), '[0-9]') AND regexp_matches(substr(md5(p_partkey::VARCHAR), 1, 6), '[a-f]') ELSE false END AS versioned FROM part"""
)
def versions_in_paths(spark, sf_dir):
    """Files named by a digest of eight or six figures, by a release, or by a size alone."""
    k, digest = F.col("p_partkey"), F.md5(F.col("p_partkey").cast("string"))
    name = F.when(k % 4 == 0, F.concat(F.lit("main."), F.substring(digest, 1, 8))).when(k % 4 == 1, F.concat(F.lit("lib-"), F.col("p_size").cast("string"), F.lit(".2"))).when(k % 4 == 2, F.concat(F.lit("x_"), F.substring(digest, 1, 6))).otherwise(F.concat(F.lit("icon"), F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", S.fingerprinted(F.concat(F.lit("/static/"), name, F.lit(".css"))).alias("versioned"))


@query(
    """WITH a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT (l_suppkey % 7)::VARCHAR)) AS x, list_sort(list(DISTINCT (l_partkey % 7)::VARCHAR)) AS y FROM lineitem GROUP BY 1)
SELECT k, array_to_string(list_sort(list_distinct(x || y)), ' ') AS "union", array_to_string(list_filter(x, lambda v: list_contains(y, v)), ' ') AS common, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ' ') AS missing,
       array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ' ') AS extra, x = y AS equal FROM a"""
)
def sets_of_orders(spark, sf_dir):
    """Two sets of each order's lines against each other."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set((F.col("l_suppkey") % 7).cast("string")).alias("x"), F.collect_set((F.col("l_partkey") % 7).cast("string")).alias("y"))
    told = lines.select("k", O.sets_compared(F.col("x"), F.col("y")).alias("s"))
    return told.select("k", *[F.array_join(f"s.{c}", " ").alias(c) for c in ("union", "common", "missing", "extra")], "s.equal")


@query("SELECT p_partkey, p_brand || ' makes ' || p_name || ' in {sizes}: ' || p_size AS text FROM part")
def filled_templates(spark, sf_dir):
    """A sentence with the cells of each row, one name left standing as nothing is known for it."""
    text = S.filled(F.lit("{brand} makes {name} in {sizes}: {size}"), {"brand": F.col("p_brand"), "name": F.col("p_name"), "size": F.col("p_size"), "sizes": F.lit(None)})
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query("SELECT doc_id, doc_id % 4 < 2 AS well_formed, doc_id % 4 < 2 AND lang = 'en' AS english FROM documents WHERE lang IS NOT NULL")
def tags_of_documents(spark, sf_dir):
    """Language tags with a region, a script, a region of four letters after one, and none but a dash."""
    n = F.col("doc_id") % 4
    tag = F.concat("lang", F.when(n == 0, "-GB").when(n == 1, "-latn-gb").when(n == 2, "-gb-latn").otherwise("-"))
    docs = read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", tag.alias("tag"))
    return docs.select("doc_id", S.language_tag(F.col("tag")).alias("well_formed"), (S.language_tag(F.col("tag")) & S.languages_agree(F.col("tag"), F.lit("en"))).alias("english"))
