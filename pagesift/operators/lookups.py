"""Joins on other than equal keys, rewritten as joins on equal keys where that is possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.urls import parents


def ipv4(address: Column) -> Column:
    """The address as a number; null for anything else."""
    p = F.split(address, r"\.")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    good = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[n(i) for i in range(1, 5)]) < 256)
    return F.when(good, ((n(1) * 256 + n(2)) * 256 + n(3)) * 256 + n(4))


def address_bits(address: Column) -> Column:
    """An IPv4 or IPv6 address as its bits in hexadecimal, 8 or 32 digits; null for anything else."""
    four = ipv4(address)
    # An IPv4 address at the end of an IPv6 one stands for two groups.
    tail = ipv4(F.regexp_extract(address, r":(\d+\.\d+\.\d+\.\d+)$", 1))
    grouped = F.when(tail.isNotNull(), F.concat(F.regexp_replace(address, r"\d+\.\d+\.\d+\.\d+$", ""), F.lower(F.hex(F.floor(tail / 65536))), F.lit(":"), F.lower(F.hex(tail % 65536)))).otherwise(address)
    halves = F.split(grouped, "::")
    groups = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    gap = F.lit(8) - F.size(left) - F.size(right)
    fine = grouped.rlike(r"(?i)^[0-9a-f:]+$") & ~F.contains(grouped, F.lit(":::")) & F.contains(grouped, F.lit(":")) & (F.size(halves) <= 2) & ((F.size(halves) == 2) & (gap >= 1) | (F.size(halves) == 1) & (gap == 0) & ~grouped.rlike("^:|:$"))
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    six = F.when(fine & F.forall(every, lambda g: F.length(g) <= 4), F.array_join(F.transform(every, lambda g: F.lpad(F.lower(g), 4, "0")), ""))
    return F.coalesce(F.when(four.isNotNull(), F.lpad(F.lower(F.hex(four)), 8, "0")), six)


def _network(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of hexadecimal digits: whole digits as they are, what is left of the next one as a number."""
    whole = F.floor(bits / 4).cast("int")
    part = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.when(bits % 4 > 0, F.floor(part / F.pow(F.lit(2.0), 4 - bits % 4)).cast("string")).otherwise("")
    return F.concat_ws("/", F.length(digits).cast("string"), bits.cast("string"), F.substring(digits, F.lit(1), whole), rest)


def in_blocks(addresses: DataFrame, blocks: DataFrame, address: str, block: str) -> DataFrame:
    """``addresses`` with the rows of ``blocks`` (CIDR notation, of both families) that hold them.

    Each address meets the block of each prefix length by equality, so nothing is compared pairwise; only lengths that
    occur among the blocks of the family are tried (at most 33 and 129, so their list is broadcast)."""
    digits = address_bits(F.split_part(block, F.lit("/"), F.lit(1)))
    known = blocks.withColumn("__d", digits).withColumn("__bits", F.split_part(block, F.lit("/"), F.lit(2)).try_cast("int"))
    known = known.where((F.col("__bits") >= 0) & (F.col("__bits") <= F.length("__d") * 4)).withColumn("__net", _network(F.col("__d"), F.col("__bits")))
    lengths = known.groupBy(F.length("__d").alias("__family")).agg(F.collect_set("__bits").alias("__lengths"))
    rows = addresses.withColumn("__d", address_bits(F.col(address))).where("__d IS NOT NULL").withColumn("__family", F.length("__d"))
    rows = rows.join(F.broadcast(lengths), "__family").withColumn("__bits", F.explode("__lengths")).withColumn("__net", _network(F.col("__d"), F.col("__bits")))
    return rows.drop("__d", "__bits", "__family", "__lengths").join(known.drop("__d", "__bits"), "__net").drop("__net")


def by_suffix(hosts: DataFrame, names: DataFrame, host: str, name: str) -> DataFrame:
    """``hosts`` with the rows of ``names`` that are the host or a parent domain of it."""
    rows = hosts.withColumn("__parent", F.explode(parents(F.lower(host))))
    return rows.join(names, F.col("__parent") == F.lower(name)).drop("__parent")


def nearest_ancestor(hosts: DataFrame, records: DataFrame, host: str, name: str, value: str) -> DataFrame:
    """(host, name, value): for each host the record of itself or its closest ancestor; hosts without one are left out."""
    rows = hosts.select(host).distinct().select(host, F.posexplode(parents(F.lower(host))).alias("__far", "__parent"))
    found = rows.join(records, F.col("__parent") == F.lower(name))
    return found.groupBy(host).agg(F.min_by(F.struct(name, value), F.struct("__far", value)).alias("r")).select(host, f"r.{name}", f"r.{value}")


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, value: str) -> DataFrame:
    """``left`` with the value of the last right row of the same key at or before its time.

    Both sides are put in one order per key, so each row is read once; no row meets all rows of its key.
    Keys that hold a large share of all rows make large windows: salt those beforehand by time range."""
    marks = right.select(*by, F.col(at), F.lit(0).alias("__side"), F.struct(F.col(value)).alias("__value"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*by, at)])
    rows = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(marks.schema["__value"].dataType))
    order = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("__last", F.last("__value", ignorenulls=True).over(order))
    return both.where("__side = 1").select(*left.columns, F.col(f"__last.{value}").alias(value))


def within(left: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: int = 3600) -> DataFrame:
    """``left`` with the intervals of the same key that hold its time (end exclusive), by equality on time bins.

    An interval is unfolded over bins as wide as itself or up to eight times less, ``width`` seconds at least, so into
    nine at most; a row meets the bins of each width that occurs (a few dozen at most; their list is broadcast)."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    step = lambda w: F.pow(F.lit(8.0), w) * (width * 1_000_000)
    bin_of = lambda t, w: F.floor(t / step(w)).cast("long")
    long = micros(end) - micros(start)
    spans = intervals.where(F.col(start) < F.col(end)).withColumn("__w", F.greatest(F.lit(0), F.floor(F.log(8.0, long / (width * 1e6)))).cast("int"))
    spans = spans.withColumn("__bin", F.explode(F.sequence(bin_of(micros(start), F.col("__w")), bin_of(micros(end) - 1, F.col("__w")))))
    widths = spans.agg(F.collect_set("__w").alias("__widths"))
    rows = left.crossJoin(F.broadcast(widths)).withColumn("__w", F.explode("__widths")).withColumn("__bin", bin_of(micros(at), F.col("__w"))).drop("__widths")
    return rows.join(spans, [*by, "__w", "__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__w", "__bin")
