"""Which language a text is in: character trigrams of words against profiles learnt from texts whose language is known.

A profile has the ``most`` frequent trigrams of a language with their weights, 1000 times the logarithm of their share,
rounded down; a trigram that isn't in it, or is rarer than ``RAREST``, has the weight of ``RAREST``. A text's score in a
language is the sum of its trigrams' weights. Whole numbers all along, so that sums don't depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters below which a text says nothing, as the reading of titles and descriptions asks for.
LEAST_LENGTH = 24
MOST_GRAMS, RAREST = 4000, 1e-5
FLOOR = math.floor(1000 * math.log(RAREST))
#: Weight by which the best language leads the second for each trigram of a text that is told reliably.
LEAD = 300
#: Characters of texts that are scored at once, table entries of a step of it, and places for trigrams up to which a table has one for each.
BLOCK, STEP, MOST_PLACES = 1 << 20, 1 << 19, 1 << 23
GUESS = "struct<language: string, confidence: double, reliable: boolean>"
_GUESS = pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("reliable", pa.bool_())])


def letters(text: Column) -> Column:
    """Words of letters in lower case, parted by single spaces."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: For each trigram in some profile its weight in each language.
    weights: dict[str, tuple[int, ...]]
    _tables: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights, "_tables": {}}

    def _built(self) -> dict:
        """``char`` gives characters numbers, ``row`` trigrams of them a row of ``worth``: weights, whether in the profile, and 1 for a letter.
        Row 0 is that of an unknown trigram, the last, all zero, that of a space in the middle."""
        if self._tables:
            return self._tables
        grams = {g: w for g, w in self.weights.items() if len(g) == 3 and g[1] != " "}
        chars = sorted({" ", *"".join(grams)})
        char, k = np.zeros(0x110000, np.int64), len(chars) + 1
        char[[ord(c) for c in chars]] = range(1, k)
        order = sorted(range(len(self.languages)), key=lambda i: self.languages[i])
        weights = np.array([(FLOOR,) * len(order), *grams.values()], np.int64)[:, order]
        worth = np.concatenate([weights, weights > FLOOR, np.ones((len(weights), 1), np.int64)], 1)
        worth = np.concatenate([worth, np.zeros((1, worth.shape[1]), np.int64)])
        keys = np.array([(char[ord(a)] * k + char[ord(b)]) * k + char[ord(c)] for a, b, c in grams], np.int64)
        space = char[32]
        if k**3 <= MOST_PLACES:
            places = np.zeros((k, k, k), np.int32)
            places.ravel()[keys] = np.arange(1, len(keys) + 1)
            places[:, space] = len(worth) - 1
            row = lambda w: places.ravel()[(w[:-2] * k + w[1:-1]) * k + w[2:]]
        else:
            by = np.argsort(keys)
            ordered = keys[by]

            def row(w):
                key = (w[:-2] * k + w[1:-1]) * k + w[2:]
                at = np.minimum(np.searchsorted(ordered, key), len(ordered) - 1)
                return np.where(w[1:-1] == space, len(worth) - 1, np.where(ordered[at] == key, by[at] + 1, 0))

        self._tables.update(char=char, row=row, worth=worth, names=[self.languages[i] for i in order])
        return self._tables

    def _sums(self, texts: Sequence[str]) -> np.ndarray:
        """The sum of ``worth`` over each text's trigrams. Each letter is the middle of one; texts are parted by spaces, as words are."""
        t = self._built()
        codes = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([0, *(len(x) + 1 for x in texts)])
        sums, before, step = np.zeros((len(ends), t["worth"].shape[1]), np.int64), 0, max(1, STEP // t["worth"].shape[1])
        for a in range(0, len(codes) - 2, step):
            so_far = t["worth"][t["row"](t["char"][codes[a : a + step + 2]])].cumsum(0) + before
            lo, hi = np.searchsorted(ends, (a, a + len(so_far)), "right")
            sums[lo:hi] = so_far[ends[lo:hi] - a - 1]
            before = so_far[-1]
        sums[ends >= len(codes) - 2] = before
        return np.diff(sums, axis=0)

    def guesses(self, texts: Sequence[str | None]) -> pa.Array:
        """The languages of texts given as ``letters``; null for null and for one without letters. Of equal scores the first name counts."""
        if not self.languages:
            return pa.nulls(len(texts), _GUESS)
        n, told = len(self.languages), [x or "" for x in texts]
        sums = np.concatenate([np.zeros((0, 2 * n + 1), np.int64), *(self._sums(told[a:z]) for a, z in _blocks(told))])
        score, total = sums[:, :n], sums[:, -1]
        best, some = score.argmax(1), np.maximum(total, 1)
        ranked = np.sort(score, 1)
        sure = ranked[:, -1] - ranked[:, -2] >= LEAD * total if n > 1 else np.ones(len(told), bool)
        known = np.take_along_axis(sums[:, n : 2 * n], best[:, None], 1)[:, 0]
        names = pa.array(self._built()["names"]).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(known * 100 // some / 100), pa.array(sure)], fields=list(_GUESS), mask=pa.array(total == 0))

    def guess(self, words: str) -> dict | None:
        """The language of one text, whose words may be parted by any white space."""
        return self.guesses([" ".join(words.split())])[0].as_py()


def _blocks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts that end once they have ``BLOCK`` characters."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def gram_counts(texts: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n). Words are counted before they are cut into trigrams; nulls in either column are left out."""
    words = texts.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.split(letters(F.col(text)), " ")).alias("word"))
    counted = words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    chars = F.split(F.concat(F.lit(" "), "word", F.lit(" ")), "")
    grams = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2)))
    return counted.withColumn("c", chars).select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(texts: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_GRAMS) -> DataFrame:
    """(lang, gram, weight): of each language the ``most`` frequent trigrams, of as frequent ones the first."""
    counts = gram_counts(texts, text, lang)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    weight = F.floor(1000 * F.log(F.col("n") / F.col("total"))).cast("int")
    return counts.withColumns({"place": place, "total": total}).where(F.col("place") <= most).select("lang", "gram", weight.alias("weight")).where(F.col("weight") > FLOOR)


def learn(texts: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_GRAMS) -> LanguageModel:
    """The model of all ``texts``. Only profiles reach the driver, ``most`` rows for each language; texts without a language teach nothing."""
    rows = profiles(texts, text, lang, most).collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    weights: dict[str, list[int]] = {}
    for r in rows:
        weights.setdefault(r["gram"], [FLOOR] * len(languages))[languages.index(r["lang"])] = r["weight"]
    return LanguageModel(languages, {g: tuple(w) for g, w in weights.items()})


def detect(text: Column, model: LanguageModel, least: int = LEAST_LENGTH) -> Column:
    """struct(language, confidence, reliable): null for a null text, one shorter than ``least`` without white space around
    it, or one without letters. Confidence is the share of trigrams that the language's profile has, in hundredths."""

    @F.arrow_udf(GUESS)
    def run(words: pa.Array) -> pa.Array:
        return model.guesses(words.to_pylist())

    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return run(F.when(F.length(bare) >= least, letters(text)))


def detected(html: Column, model: LanguageModel) -> Column:
    """The fact html.detected: guesses for the title and for the description of a page."""
    return F.when(html.isNotNull(), F.struct(detect(html["title"], model).alias("title"), detect(F.try_element_at(html["meta"], F.lit("description")), model).alias("description")))


def disagreeing(lang: Column, guesses: Column) -> Column:
    """What a page's texts read as where that isn't the language it declares: an array of sentences. Null if no language is
    declared or nothing was guessed; guesses that aren't reliable don't count."""
    declared = F.lower(F.split_part(lang, F.lit("-"), F.lit(1)))
    off = lambda n: F.when(guesses[n]["reliable"] & (guesses[n]["language"] != declared), F.concat(F.lit(f"{n} reads as "), guesses[n]["language"], F.lit(" ("), F.regexp_replace(guesses[n]["confidence"].cast("string"), r"\.0$", ""), F.lit(")")))
    return F.when((F.coalesce(lang, F.lit("")) != "") & guesses.isNotNull(), F.array_compact(F.array(off("title"), off("description"))))
