"""Statistics over page facts: outliers, minorities, inconsistencies, summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.sources.scratch import cut

#: What makes the median and the mean absolute deviation estimates of a standard deviation.
MAD_SCALE, MEAN_SCALE = 0.6745, 0.797885


def ranked(df: DataFrame, by: list[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column for each of ``ranks``): in each group the value at a rank, from 1, that is told from the number of values n.

    Nulls are left out. Values are counted first, within tasks; the counts are dealt to ranges of (by, value), and only
    the range that holds a rank is ordered. So a group of any size, with any number of values, is no single task's work."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    ranged = cut(counts.repartitionByRange(*[F.col(c) for c in by], "__v").withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__c").alias("__s"))  # a row for each group and range
    whole = Window.partitionBy(*by)
    sums = sums.withColumn("n", F.sum("__s").over(whole)).withColumn("__upto", F.sum("__s").over(whole.orderBy("__range")))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for k, rank in ranks.items()]))
    wanted = sums.withColumn("w", wanted).where((F.col("w.rank") <= F.col("__upto")) & (F.col("w.rank") > F.col("__upto") - F.col("__s")))
    wanted = wanted.select(*by, "__range", "n", F.col("w.name").alias("__name"), (F.col("w.rank") - F.col("__upto") + F.col("__s")).alias("__rank"))
    inside = ranged.withColumn("__place", F.sum("__c").over(Window.partitionBy(*by, "__range").orderBy("__v")))
    found = inside.join(wanted, [*by, "__range"]).where("__place >= __rank").groupBy(*by, "__name").agg(F.min("__v").alias("__v"), F.first("n").alias("n"))
    return found.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in ranks])


#: The two values in the middle, which are one where their number is odd.
MIDDLE = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1}


def middle(low: str = "low", high: str = "high") -> Column:
    return (F.col(low).cast("double") + F.col(high).cast("double")) / 2


#: Groups whose few numbers are sent to all tasks.
FEW_GROUPS = 100_000


def _told_all(groups: DataFrame) -> DataFrame:
    """One row for each group, sent to all tasks while they are few, so that rows of a large group stay where they are."""
    groups = cut(groups)
    return F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups


def outliers(df: DataFrame, key: str, value: str, by: list[str] | None = None, limit: float = 3.5, times: float = 3.0, least: int = 20) -> DataFrame:
    """(by, key, value, median, z): rows whose robust z-score exceeds ``limit`` and that are ``times`` the median.

    The scale is the median absolute deviation, or the mean one where that is 0; groups under ``least`` rows
    have no outliers. Null values are left out. Medians come from counts of values (``ranked``) and are joined back,
    so that a large group is summed up within tasks first."""
    by = by or []
    rows = df.where(F.col(value).isNotNull()).withColumn("__all", F.lit(1))
    on = ["__all", *by]
    center = ranked(rows, on, value, MIDDLE).select(*on, "n", middle().alias("median"))
    spread = rows.join(_told_all(center), on).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mad = ranked(spread, on, "off", MIDDLE).select(*on, middle().alias("mad"))
    scale = spread.groupBy(*on).agg(F.avg("off").alias("mean_off")).join(mad, on)
    scale = scale.withColumn("scale", F.when(F.col("mad") > 0, F.col("mad") / MAD_SCALE).otherwise(F.col("mean_off") / MEAN_SCALE))
    judged = spread.join(_told_all(scale), on).where((F.col("n") >= least) & (F.col("scale") > 0))
    z = (F.col(value) - F.col("median")) / F.col("scale")
    return judged.withColumn("z", z).where((F.col("z") > limit) & (F.col(value) >= times * F.col("median"))).select(*by, key, value, "median", "z")


def dominating(df: DataFrame, key: str, value: str, followers: int = 10) -> DataFrame:
    """(key, value, rest): the row with the largest value, where that exceeds the sum of the next ``followers`` together."""
    top = df.where(F.col(value).isNotNull()).orderBy(F.desc(value), key).limit(followers + 1)  # taken within tasks first
    ranks = top.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(value), key)))
    first = ranks.where("__r = 1").select(key, value)
    rest = ranks.where("__r > 1").agg(F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("rest"))
    return first.crossJoin(F.broadcast(rest)).where(F.col(value) > F.col("rest")).select(key, value, "rest")


def minorities(df: DataFrame, value: str, by: list[str] | None = None, share: float = 0.1, dominant: float = 0.8, least: int = 20) -> DataFrame:
    """(by, value, n, total): values held by at most ``share`` of a group in which one value has ``dominant`` or more."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)  # over counted values, not rows
    counted = counts.withColumn("total", F.sum("n").over(group)).withColumn("most", F.max("n").over(group))
    keep = (F.col("total") >= least) & (F.col("most") >= dominant * F.col("total")) & (F.col("n") <= share * F.col("total"))
    return counted.where(keep).select(*by, value, "n", "total")


def majority_form(df: DataFrame, key: str, form: str, by: list[str], order: str) -> DataFrame:
    """(by, key, form, usual): rows whose form isn't their group's most frequent one; of equals the form met first in ``order``.
    Rows with a null form aren't judged."""
    judged = df.where(F.col(form).isNotNull())
    counts = judged.groupBy(*by, form).agg(F.count("*").alias("n"), F.min(order).alias("met"))
    usual = counts.groupBy(*by).agg(F.max_by(form, F.struct("n", (-F.col("met")).alias("earlier"))).alias("usual"))
    return judged.join(usual, by).where(F.col(form) != F.col("usual")).select(*by, key, form, "usual")


def inconsistent(df: DataFrame, subject: str, facts: list[str]) -> DataFrame:
    """(subject, fact, values, listed): facts that have two values or more for one subject; listed are the values, each once."""
    long = df.select(subject, F.explode(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).cast("string").alias("value")) for f in facts])).alias("x")).select(subject, "x.*").where("value IS NOT NULL")
    return long.groupBy(subject, "fact").agg(F.count_distinct("value").alias("values"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("listed")).where("values > 1")


def value_counts(df: DataFrame, subject: str, facts: list[str], ignored: Column | None = None) -> DataFrame:
    """(subject, fact, value, n): of facts with two values or more for a subject each value with its count, most frequent
    ones to be taken by the caller. Rows for which ``ignored`` names a fact (an address behind a delivery network) don't count for it."""
    long = df.select(subject, (ignored if ignored is not None else F.lit(None).cast("string")).alias("__no"), F.explode(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).cast("string").alias("value")) for f in facts])).alias("x")).where("x.value IS NOT NULL AND NOT (__no <=> x.fact)")
    counts = long.groupBy(subject, "x.fact", "x.value").agg(F.count("*").alias("n"))
    several = counts.groupBy(subject, "fact").agg(F.count("*").alias("__k")).where("__k > 1").drop("__k")
    return counts.join(several, [subject, "fact"])


def numeric_summary(df: DataFrame, columns: list[str], unsummed: tuple[str, ...] = ("depth", "rank", "max-age", "max_age"), unjudged: tuple[str, ...] = ("status",)) -> DataFrame:
    """(fact, count, min, median, p95, max, total) per numeric column; p95 is the nearest rank.

    Columns whose last name is among ``unjudged`` are left out; those among ``unsummed`` have no total, as it means nothing."""
    last = lambda c: c.rsplit(".", 1)[-1]
    columns = [c for c in columns if last(c) not in unjudged]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL")
    r = lambda c: F.round(c, 4)
    sums = long.groupBy("fact").agg(F.count("*").alias("count"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.sum("value")).alias("total"))
    inner = ranked(long, ["fact"], "value", {**MIDDLE, "p95": lambda n: F.ceil(n * 0.95)}).select("fact", r(middle()).alias("median"), r("p95").alias("p95"))
    total = F.when(~F.col("fact").isin(*[c for c in columns if last(c) in unsummed]), F.col("total")) if any(last(c) in unsummed for c in columns) else F.col("total")
    return sums.join(inner, "fact").select("fact", "count", "min", "median", "p95", "max", total.alias("total"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, median): the element in the middle, the upper one of two."""
    return ranked(df, by, value, {"median": MIDDLE["high"]})


def gaps_eta(df: DataFrame, by: list[str], at: str, tie: str, last: int = 50, z: float = 2.0) -> DataFrame:
    """(by, at, tie, gaps, elapsed microseconds, mean, low, high): mean and interval of the last gaps between events, from three gaps on."""
    order = Window.partitionBy(*by).orderBy(at, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = df.withColumn("gap_us", micros - F.lag(micros).over(order)).withColumn("gap", F.col("gap_us") / 1e6)
    recent = order.rowsBetween(-(last - 1), 0)
    out = gap.withColumns({"gaps": F.count("gap").over(recent), "elapsed": F.sum("gap_us").over(recent), "mean": F.avg("gap").over(recent), "var": F.var_samp("gap").over(recent)}).where("gaps >= 3")
    half = z * F.sqrt(F.col("var") / F.col("gaps"))
    return out.select(*by, at, tie, "gaps", "elapsed", F.round("mean", 4).alias("mean"), F.round(F.col("mean") - half, 4).alias("low"), F.round(F.col("mean") + half, 4).alias("high"))


def samples(df: DataFrame, by: list[str], order: str, k: int = 3) -> DataFrame:
    """The first ``k`` rows of each group in order: Spark cuts each task's share of a group before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("place") <= k)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)
