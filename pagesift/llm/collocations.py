"""Phrase collocation mining: counts of all phrases of two to five words, scored by their weakest cut.

1. Words are counted by language, in each task first. Those that occur ``LEAST`` times or more get an id, which names the
   language too. A phrase that occurs so often has only such words, so pieces are broken at all others.
2. Each place where two words or more follow gives one fixed-width key: the ids of the next five words, zeros behind a
   break. A task sorts its keys by radix, counts runs of equal ones, and cuts them into key ranges, whose borders come
   from a bounded sample of rows. The key of five words counts for all its beginnings at once.
3. The task of a range merges its parts by the same sort and counts runs of equal beginnings of two to five words. What
   begins or ends a range may go on in the next one, so these counts are added up once more.
4. Cuts, scores, and phrases that a longer one makes superfluous are joins of the frequent phrases alone.
5. Ranks come from a range-partitioned order and the number of rows in each range before, so a language is no task.

The ids are sent to all tasks if there are few (``MOST_LOCAL``). Beyond that a text's block of rows gets only the ids of
words in it, by a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, stored, table

LEAST, LONGEST, BEST = 100, 5, 2000
#: Words whose ids are sent to all tasks; with more, each block of rows gets the ids of its own words.
MOST_LOCAL = 300_000
#: Different words that a task counts, and keys that it collects, before it passes them on.
MOST_COUNTED, MOST_KEYS = 200_000, 2_000_000
#: Bytes of text in a block of rows, keys in a range on average, and keys that borders are taken from.
BLOCK_BYTES, RANGE_KEYS, SAMPLE_KEYS = 8 << 20, 1_000_000, 200_000
_BREAK = b"."
#: A-Z as a-z, and a line break for each byte that ends a piece.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8 and, where a piece ends, a full stop, which no word is."""
    return text.translate(_PLAIN).replace(b"\n", b" . ").split()


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) with null languages as ``und``; null and empty texts hold no words."""
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("length(text) > 0")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f); word null has the number of all words of the language."""

    def run(batches):
        import pyarrow as pa

        counts: dict[str, Counter] = {}

        def told():
            for lang, c in counts.items():
                c.pop(_BREAK, None)
                words = [None, *c]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.binary()), pa.array([c.total(), *c.values()], pa.int64())], ["lang", "word", "f"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > MOST_COUNTED:
                yield from told()
        yield from told()

    return in_arrow(texts, run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def with_ids(words: DataFrame) -> DataFrame:
    """(lang, word, f, id): ids from 1, numbered within blocks of hashed words, so that no task numbers all."""
    block = F.pmod(F.xxhash64("lang", "word"), F.lit(1024).cast("long"))
    numbered = words.withColumn("block", block).withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("lang", "word")))
    before = numbered.groupBy("block").count().select("block", (F.sum("count").over(Window.orderBy("block")) - F.col("count")).alias("before"))
    return numbered.join(before, "block").select("lang", "word", "f", (F.col("before") + F.col("r")).alias("id"))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of the rows of ``keys`` (n, k) uint32, by digits of 16 bits from the last to the first."""
    order = np.arange(len(keys))
    for j in reversed(range(keys.shape[1])):
        for shift in (0, 16):
            digit = (keys[:, j] >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows each once, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[starts], np.add.reduceat(counts, starts)


def ngram_keys(ids: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """(n, longest) uint32: from each place with two ids or more the ids up to the next break (0)."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    keys = padded[at[:, None] + np.arange(longest)]
    keys[np.logical_or.accumulate(keys == 0, axis=1)] = 0
    return keys


def packed(keys: np.ndarray) -> np.ndarray:
    """Rows of ids as big-endian bytes, whose order is that of the ids."""
    width = 4 * keys.shape[1]
    return np.ascontiguousarray(keys.astype(">u4")).view(f"V{width}").ravel()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, ">u4").reshape(-1, width).astype(np.uint32)


class _Keys:
    """Collects the keys of a task's texts; gives (range, keys, counts) of what it has, sorted and counted."""

    def __init__(self, borders: np.ndarray, longest: int):
        self.borders, self.longest, self.held, self.n = [bytes(x) for x in packed(borders)], longest, [], 0

    def add(self, words: list[bytes], get) -> None:
        keys = ngram_keys(np.fromiter((get(w, 0) for w in words), np.uint32, len(words)), self.longest)
        self.n += len(keys)
        self.held.append(keys)

    def told(self):
        import bisect

        import pyarrow as pa

        if not self.n:
            return
        keys = np.concatenate(self.held)
        self.held, self.n = [], 0
        order = radix_order(keys)
        keys, counts = run_lengths(keys[order], np.ones(len(order), np.int64))
        del order
        raw = packed(keys)
        edges = [0, *(bisect.bisect_left(raw, x, key=bytes) for x in self.borders), len(keys)]
        for part, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
            for at in range(a, z, 50_000):
                to = min(z, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw[at:to].tobytes()], pa.binary()), pa.array([counts[at:to].tobytes()], pa.binary())], ["part", "keys", "counts"])


_PARTS = "part int, keys binary, counts binary"


def _local_keys(texts: DataFrame, ids: DataFrame, borders: np.ndarray, longest: int) -> DataFrame:
    """The parts of keys of all texts, with all ids sent to each task."""
    spark, known = texts.sparkSession, {}
    for r in ids.select("lang", "word", "id").toLocalIterator():
        known.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
    sent = spark.sparkContext.broadcast(known)

    def run(batches):
        keys = _Keys(borders, longest)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.add([*tokens(text), _BREAK], sent.value.get(lang, {}).get)
                if keys.n > MOST_KEYS:
                    yield from keys.told()
        yield from keys.told()

    return in_arrow(texts, run, _PARTS)


def _joined_keys(texts: DataFrame, ids: DataFrame, borders: np.ndarray, longest: int) -> DataFrame:
    """The same, where each block of rows gets the ids of its own words only."""

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, k, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            names = []
            for text in b.column(1).to_pylist():
                k, size = (k + 1, len(text)) if size + len(text) > BLOCK_BYTES else (k, size + len(text))
                names.append(f"{task}-{k}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *b.columns], ["block", "lang", "text"])

    def words(batches):
        import pyarrow as pa

        for b in batches:
            found = {(block, lang, w) for block, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in tokens(text) if w != _BREAK}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["block", "lang", "word"])

    def encode(of_block, of_words):
        import pyarrow as pa

        known: dict[str, dict] = {}
        for lang, word, i in zip(*(of_words.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
            known.setdefault(lang, {})[word] = i
        keys = _Keys(borders, longest)
        for lang, text in zip(of_block.column("lang").to_pylist(), of_block.column("text").to_pylist(), strict=True):
            keys.add([*tokens(text), _BREAK], known.get(lang, {}).get)
        return pa.Table.from_batches(list(keys.told()), pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    rows = stored(in_arrow(texts, blocks, "block string, lang string, text binary"), "blocks")
    own = in_arrow(rows, words, "block string, lang string, word binary").distinct().join(ids.select("lang", "word", "id"), ["lang", "word"])
    return rows.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(encode, _PARTS)


def _merged(parts: DataFrame, ranges: int, least: int, longest: int) -> DataFrame:
    """(key, f) of phrases of two words or more that occur ``least`` times, from the parts of all tasks."""

    def run(batches):
        import pyarrow as pa

        held, numbers, at = [], [], None

        def told():
            keys, counts = np.concatenate(held), np.concatenate(numbers)
            order = radix_order(keys)
            keys, counts = run_lengths(keys[order], counts[order])
            for k in range(2, longest + 1):
                of, f = run_lengths(keys[:, :k], counts)
                good = (f >= least) & (of[:, -1] > 0)
                good[[0, -1]] |= of[[0, -1], -1] > 0  # may go on in the next range
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in packed(of[good])], pa.binary()), pa.array(f[good])], ["key", "f"])

        for b in batches:
            for part, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at and held:
                    yield from told()
                    held, numbers = [], []
                at = part
                held.append(_unpacked(keys, longest))
                numbers.append(np.frombuffer(counts, np.int64))
        if held:
            yield from told()

    dealt = parts.repartitionById(ranges, "part").sortWithinPartitions("part")
    return in_arrow(dealt, run, "key binary, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _borders(texts: DataFrame, ids: DataFrame, words: int, longest: int, keys_of) -> np.ndarray:
    """Keys that part all keys into ranges of about ``RANGE_KEYS``, from a sample of rows; results don't depend on them."""
    ranges, none = max(1, -(-words // RANGE_KEYS)), np.zeros((0, longest), np.uint32)
    if ranges == 1:
        return none
    few = keys_of(texts.sample(min(1.0, SAMPLE_KEYS / words), 11), ids, none, longest)
    found = np.concatenate([none, *(_unpacked(bytes(r["keys"]), longest) for r in few.toLocalIterator())])
    found = found[radix_order(found)]
    return np.unique(found[np.linspace(0, len(found), ranges + 1)[1:-1].astype(int)], axis=0) if len(found) else none


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, most_local: int = MOST_LOCAL) -> tuple[DataFrame, DataFrame]:
    """((lang, word, f, id), (key, f)): words that occur ``least`` times, word null for all words of a language, and phrases
    of one to ``longest`` words as keys of four bytes an id."""
    texts = _texts(df, text_col, lang_col)
    counted = stored(word_counts(texts).where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    ids = stored(with_ids(counted.where("word IS NOT NULL")), "ids")
    size = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()
    if size["n"] >= 2**32:
        raise ValueError("more frequent words than ids of 32 bits")
    keys_of = _local_keys if size["n"] <= most_local else _joined_keys
    borders = _borders(texts, ids, size["f"], longest, keys_of)
    phrases = _merged(keys_of(texts, ids, borders, longest), len(borders) + 1, least, longest)
    one = ids.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f")
    totals = counted.where("word IS NULL").select("lang", F.lit(None).cast("binary").alias("word"), "f", F.lit(None).cast("long").alias("id"))
    return ids.unionByName(totals), stored(phrases.unionByName(one), "phrases")


def _words(key: str) -> Column:
    return (F.length(key) / 4).cast("int")


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, key, a, l, r, n, score) of all phrases of two words or more: the cut with the lowest score, of equals the first."""
    candidates = phrases.where(_words("key") > 1).select("key", F.col("f").alias("a"))
    totals = words.where("word IS NULL").select("lang", F.col("f").alias("n"))
    first = words.where("word IS NOT NULL").select("lang", F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("head"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), _words("key") - 1))).withColumn("left", F.expr("substring(key, 1, 4 * k)")).withColumn("right", F.expr("substring(key, 4 * k + 1, length(key))"))
    cuts = cuts.join(phrases.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(phrases.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("head", F.expr("substring(key, 1, 4)")).join(first, "head").join(F.broadcast(totals), "lang")
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    least = cuts.select("lang", "key", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "key", "a", "n").agg(F.min("cut").alias("cut"))
    return least.select("lang", "key", "a", "cut.l", "cut.r", "n", "cut.score")


def superfluous(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, a): phrases that a longer one holds which occurs as often."""
    parts = [(i, k) for k in range(2, longest) for i in range(longest - k + 1)]
    inner = F.array(*[F.when((F.lit(i + k) <= _words("key")) & (_words("key") > k), F.expr(f"substring(key, {4 * i + 1}, {4 * k})")) for i, k in parts])
    held = phrases.where(_words("key") > 2).select(F.explode(F.array_compact(inner)).alias("key"), F.col("f").alias("a"))
    return held.distinct()


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int = BEST, most_local: int = MOST_LOCAL) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``best`` phrases of two to ``longest`` words.

    A phrase's words stand in one piece of a text and occur ``least`` times there, a; l and r are the counts of the parts of
    its weakest cut, n all words of the language, score floor(1000 * a * n / (l * r)). Phrases that a longer one holds as
    often as they occur are left out. Order: score, then a, falling, then the phrase's bytes.

    Null languages count as ``und``. Null and empty texts hold no words. Rows that repeat count as often as they stand.
    An empty table, or one without frequent phrases, gives an empty result. Other columns are not read. Numbers are exact
    while a * n * 1000 has at most 38 digits; the score must fit 64 bits.
    """
    words, phrases = phrase_counts(df, text_col, lang_col, least, longest, most_local)
    kept = scored(words, phrases).join(superfluous(phrases, longest), ["key", "a"], "left_anti")
    spark: SparkSession = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that tie in score and a are in one range, so that ranges can be cut off before phrases are spelt.
    ranged = stored(kept.repartitionByRange(parts, F.col("lang"), F.desc("score"), F.desc("a")).withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("lang", "range").count()
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("range")) - F.col("count")
    top = ranged.join(F.broadcast(sizes.select("lang", "range", before.alias("before")).where(F.col("before") < best)), ["lang", "range"])
    spelt = top.select("key", F.posexplode(F.sequence(F.lit(1), _words("key"))).alias("at", "j")).withColumn("id", F.conv(F.hex(F.expr("substring(key, 4 * j - 3, 4)")), 16, 10).cast("long"))
    names = words.where("word IS NOT NULL").select("id", F.col("word").cast("string").alias("word"))
    spelt = spelt.join(names, "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("key", F.array_join("w.word", " ").alias("phrase"))
    order = Window.partitionBy("lang", "range").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = top.join(spelt, "key").withColumn("rank", F.col("before") + F.row_number().over(order))
    return ranked.where(F.col("rank") <= best).select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


SQL = {
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents),
runs AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang),
places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
grams AS (
  SELECT lang, i, w, unnest(range(1, 6)) AS k FROM places),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS (
  SELECT lang, k AS words, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT lang, words, phrase, a, w, unnest(range(1, words)) AS c FROM candidates),
judged AS (
  SELECT cut.lang, cut.words, cut.phrase, cut.a, cut.c, x.a AS l, y.a AS r, n, ((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut JOIN totals USING (lang)
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : c], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[c + 1 : words], ' ')),
weakest AS (
  SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (
  SELECT DISTINCT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, words, i, unnest(range(2, words)) AS m FROM (SELECT *, unnest(range(1, words)) AS i FROM candidates)) WHERE i + m - 1 <= words),
kept AS (
  SELECT * FROM weakest ANTI JOIN inner_parts USING (lang, phrase, a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000"""
}
QUERIES = {"op11_collocations": op11_collocations}
