"""Queries that detect languages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions import language as N
from pagesift.plans.pages import FACTS, read

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Three quarters of the documents teach, told by a hash of their id; all are judged.
_TEACHES = "substr(md5(CAST(doc_id AS {text})), 1, 1) < 'c'"


def _model(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return N.learn(docs.where(_TEACHES.format(text="STRING")))


def _guesses(texts: str) -> str:
    """SQL for guessed (id, language, confidence, reliable) of a relation ``texts`` (id, text)."""
    letters = "trim(lower(regexp_replace({0}, '[^\\p{{L}}]+', ' ', 'g')))"
    grams = "unnest(list_transform(range(length(word)), lambda i: substr(' ' || word || ' ', i + 1, 3)))"
    return rf"""
learnt AS (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split({letters.format("text")}, ' ')) AS word FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND {_TEACHES.format(text="VARCHAR")})
  WHERE word <> '' GROUP BY ALL),
counted AS (
  SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, {grams} AS gram FROM learnt) GROUP BY ALL),
profiles AS (
  SELECT lang, gram, floor(1000 * ln(n / sum(n) OVER (PARTITION BY lang)))::BIGINT AS weight
  FROM counted QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {N.MOST_GRAMS} AND weight > {N.FLOOR}),
texts AS ({texts}),
words AS (
  SELECT id, word, count(*) AS n FROM (SELECT id, unnest(string_split({letters.format("text")}, ' ')) AS word FROM texts WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= {N.LEAST_LENGTH})
  WHERE word <> '' GROUP BY ALL),
languages AS (SELECT DISTINCT lang FROM profiles),
split_words AS (SELECT word, {grams} AS gram FROM (SELECT DISTINCT word FROM words)),
of_word AS (
  SELECT word, l.lang, sum(coalesce(weight, {N.FLOOR})) AS score, count(weight) AS known, count(*) AS total
  FROM split_words CROSS JOIN languages l LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = split_words.gram GROUP BY ALL),
of_text AS (
  SELECT id, lang, sum(n * score) AS score, sum(n * known) AS known, sum(n * total) AS total FROM words JOIN of_word USING (word) GROUP BY ALL),
guessed AS (
  SELECT id, lang AS language, floor(known * 100 / total) / 100.0::DOUBLE AS confidence, score - lead(score) OVER best >= {N.LEAD} * total AS reliable
  FROM of_text WINDOW best AS (PARTITION BY id ORDER BY score DESC, lang) QUALIFY row_number() OVER best = 1)"""


def language_detect(spark, sf_dir):
    """Each document's language, guessed from its whole text."""
    docs = read(spark, sf_dir, "documents")
    guess = N.detect(F.col("text"), _model(spark, sf_dir))
    return docs.select("doc_id", "lang", (~F.expr(_TEACHES.format(text="STRING"))).alias("held_out"), guess.alias("g")).select("doc_id", "lang", "held_out", "g.*")


SQL["language_detect"] = f"""WITH {_guesses("SELECT doc_id AS id, text FROM documents")}
SELECT doc_id, lang, NOT {_TEACHES.format(text="VARCHAR")} AS held_out, language, confidence, reliable FROM documents LEFT JOIN guessed ON id = doc_id"""


def metadata_language(spark, sf_dir):
    """Pages whose title reads as another language than the page declares."""
    facts = read(spark, sf_dir, "pages").select("page_id", H.lang(F.col("html")).alias("lang"), H.title(F.col("html")).alias("title"), H.meta(F.col("html"), "description").alias("description"))
    model = _model(spark, sf_dir)
    guesses = F.struct(N.detect(F.col("title"), model).alias("title"), N.detect(F.col("description"), model).alias("description"))
    told = facts.select("page_id", "lang", guesses.alias("g")).select("page_id", "lang", F.col("g.title.language").alias("title_language"), F.col("g.title.reliable").alias("reliable"), N.disagreeing(F.col("lang"), F.col("g")).alias("off"))
    return told.select("page_id", "lang", "title_language", "reliable", F.size("off").alias("faults"))


SQL["metadata_language"] = f"""WITH {FACTS}, {_guesses("SELECT page_id AS id, title AS text FROM facts")}
SELECT page_id, lang, language AS title_language, reliable, CASE WHEN lang IS NULL THEN -1 WHEN reliable AND language <> lower(split_part(lang, '-', 1)) THEN 1 ELSE 0 END::INTEGER AS faults
FROM facts LEFT JOIN guessed ON id = page_id"""

QUERIES.update(language_detect=language_detect, metadata_language=metadata_language)
