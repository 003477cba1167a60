"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

1. Each whole text gives its shingle set, a 128-bit key of the set, and band keys of its signature. Rows
   with equal keys form a class; from here on a class counts once, however many copies it has.
2. Classes that share a band key are candidates. Only their sets are made again, from the texts (a Bloom
   filter of bounded size keeps other texts out of that pass).
3. In each bucket the member with the most bucket neighbours is the pivot; members are verified against it,
   and links found make components. A large group of near copies becomes one component with as many
   pairs as members.
4. Where a bucket still holds several components, each member outside the largest is paired with all members
   of other components, once a pair (in the first band they share), so a link can only be missed if no band
   holds both documents.
5. A pair is verified on full sets, but not before their bitmaps leave a chance: each set has 1,024 bits, and
   as many shingles of a set as it has bits that the other lacks are certainly not shared. This is asked within
   the join of step 4, so that members of a crowded bucket that are no links give no rows.

A link of similarity s is missed with probability (1 - s**ROWS)**BANDS: 2e-8 at 0.85, 3e-6 at 0.8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stored, table
from .components import components
from .shingles import band_keys, bitmap, circulant_signature, shingle_set

BANDS, ROWS = 24, 4
#: The filter of step 2 has 2**20 words of 64 bits at most when broadcast.
FILTER_WORDS = 2**20
#: 64-bit words of a set's bitmap.
MAP_WORDS = 16


def shingle_keys(df: DataFrame, id_col: str, text_col: str, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, key, bands) for each row; key and bands are null for a text without words."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            n, keys, band = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                band.append(band_keys(circulant_signature(s, bands * rows), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64()))], [id_col, "n", "key", "bands"])

    kind = dict(df.dtypes)[id_col]
    return in_arrow(df.select(id_col, F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, n long, key binary, bands array<long>")


def shingle_sets(df: DataFrame, text_col: str, words: int = 5) -> DataFrame:
    """(key, map, shingles array<long>) for each row with words; map has a bit for each shingle, by its lowest bits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                sets = [s for t in whole.slice(at, 500).column(0).to_pylist() if len(s := shingle_set(t, words))]
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                maps, shingles = (pa.array(x, pa.list_(pa.int64())) for x in ([bitmap(s, MAP_WORDS) for s in sets], [s.view(np.int64) for s in sets]))
                yield pa.RecordBatch.from_arrays([keys, maps, shingles], ["key", "map", "shingles"])

    return in_arrow(df.select(F.col(text_col).cast("string")), run, "key binary, map array<long>, shingles array<long>")


def _hash_bits(col: str) -> tuple[Column, Column]:
    """Word and bit of a Bloom filter."""
    h = F.xxhash64(col)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, shift) % 64).cast("int"))
    return F.pmod(h, F.lit(FILTER_WORDS).cast("long")), bit(52).bitwiseOR(bit(40))


def _possibly_in(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id may be among ``ids``: all that are, and few others."""
    word, mask = _hash_bits(id_col)
    bits = ids.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))
    rows = df.withColumns({"__word": word, "__mask": mask})
    return rows.join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask")).select(*df.columns)


def _reaches(shared: Column, n_a: Column, n_b: Column, part: int, whole: int) -> Column:
    return whole * shared >= part * (n_a + n_b - shared)


def _could(part: int, whole: int) -> Column:
    """Whether sets a and b may be similar enough, by what their bitmaps tell: a shingle whose bit the other
    set lacks isn't shared. Never false for sets that are."""
    lacks = lambda x, y: sum((F.bit_count(F.col(f"m{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"m{y}")[i]))) for i in range(MAP_WORDS)), F.lit(0))
    most = F.least(F.col("na") - lacks("a", "b"), F.col("nb") - lacks("b", "a"))
    return _reaches(most, F.col("na"), F.col("nb"), part, whole)


def _verified(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(_reaches(shared, F.size("sa"), F.size("sb"), part, whole)).select("a", "b")


def class_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, part: int, whole: int) -> DataFrame:
    """(node, component) of the classes that are linked with others. ``classes`` is (key, id, n, bands)."""
    members = classes.select("key", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("band", "bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = stored(members.join(shared, ["band", "bucket"]), "members")
    degrees = stored(members.groupBy("key").agg(F.sum("crowd").alias("degree"), F.min("n").alias("n")), "degrees")
    wanted = classes.join(degrees, "key", "left_semi").select("id")
    sets = stored(shingle_sets(_possibly_in(docs.select(F.col(id_col).alias("id"), text_col), wanted, "id"), text_col, words).join(degrees, "key", "left_semi").dropDuplicates(["key"]), "sets")
    maps = sets.select("key", "map")
    side = lambda df, k: df.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("map").alias(f"m{k}"))

    pivots = members.join(degrees.select("key", "degree"), "key").groupBy("band", "bucket").agg(F.max(F.struct("degree", "key")).alias("p")).select("band", "bucket", F.col("p.key").alias("b"))
    star = members.join(pivots, ["band", "bucket"]).select(F.col("key").alias("a"), "b").where("a <> b").distinct()
    known = degrees.select("key", "n").join(maps, "key")
    star = star.join(side(known, "a"), "a").join(side(known, "b"), "b").where(_could(part, whole)).select("a", "b")
    first = stored(_verified(star, sets, part, whole), "links")
    names = components(first)

    named = members.drop("crowd").join(names.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = stored(named, "named")
    crowds = named.groupBy("band", "bucket", "component").agg(F.count("*").alias("crowd")).groupBy("band", "bucket")
    mixed = crowds.agg(F.count("*").alias("parts"), F.max(F.struct("crowd", "component")).alias("most")).where("parts > 1").select("band", "bucket", F.col("most.component").alias("main"))
    named = stored(named.join(mixed, ["band", "bucket"]).join(classes.select("key", "bands"), "key").join(maps, "key"), "named")
    one, two = (named.select("band", "bucket", "main", *(F.col(c).alias(c[0] + k) for c in ("key", "n", "map", "component")), F.col("bands").alias(f"bands_{k}")).withColumnRenamed(f"k{k}", k) for k in "ab")
    # The pair's first shared band: no earlier element of the two lists is equal.
    earlier = F.exists(F.zip_with(F.slice("bands_a", F.lit(1), F.col("band")), F.slice("bands_b", F.lit(1), F.col("band")), lambda x, y: x == y), lambda x: x)
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    rest = one.where("ca <> main").join(two.drop("main"), ["band", "bucket"]).where(apart & _could(part, whole) & ~earlier).select("a", "b")
    second = stored(_verified(stored(rest, "rest"), sets, part, whole), "links")
    if not second.limit(1).count():
        return names
    return components(first.unionByName(second))


def near_duplicates(df: DataFrame, part: int = 80, whole: int = 100, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``df``.

    Rows are linked if whole * |intersection| >= part * |union| of their shingle sets; component_id is the
    smallest id reachable over links, and the row with it is kept. Texts that are null, empty or without
    words have no shingles and are linked with nothing. Rows with a null id take part; a component of such
    rows alone has a null component_id and they are kept. Rows that share an id share what concerns the id.
    Other columns are not read.
    """
    docs = df.select(id_col, text_col)
    keys = stored(shingle_keys(docs, id_col, text_col, words), "keys")
    classes = stored(keys.where("n > 0").groupBy("key").agg(F.min(id_col).alias("id"), F.min("n").alias("n"), F.min("bands").alias("bands")), "classes")
    names = class_links(docs, classes, id_col, text_col, words, part, whole)
    linked = classes.join(names.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("component", "key").alias("component"))
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    # Written, so that a class with very many rows can be split when it meets them.
    told = stored(linked.join(least, "component").select("key", "component_id"), "told")
    out = keys.select(id_col, F.col("n").alias("n_shingles"), "key").join(told, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, one of each group, with its columns: the one with the smallest id, of rows that share it
    the one whose text has the smallest hash; a null id comes after all others. A row is told by its id and its text,
    so that of two texts with one id either may go alone. Rows that repeat both stay or go together."""
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text")).alias("__row")
    gone = near_duplicates(df.select(row, text_col), id_col="__row", text_col=text_col, **options).where(~F.col("kept")).select("__row")
    return df.withColumn("__row", row).join(gone, "__row", "left_anti").select(*df.columns)


def op5_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), part=85, whole=100)


SQL: dict[str, str] = {}
QUERIES = {"op5_near_dedup": op5_near_dedup}
