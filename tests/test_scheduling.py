"""The spread of a budget against picking one page after the other; groups that settle; places within hot groups."""

import random
from collections import defaultdict
from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagesift.operators import ranking, scheduling
from pagesift.plans import crawling

DATA = "/root/testdata/sf0.001"


class Node:
    def __init__(self):
        self.children, self.own, self.taken, self.own_taken, self.own_seen, self.waiting = {}, [], 0, 0, 0, 0


def picked(events, limit=None, fanout=32):
    """(url, seq) in the order of picks; events are (seq, url, noted)."""
    root, known = Node(), set()
    for seq, url, noted in sorted(events):
        if url is None or (page := url.split("#")[0]) in known:
            continue
        at = urlsplit(page)
        node, path = root, []
        for name in [at.netloc.lower(), *[p for p in at.path.split("/") if p][:-1]]:
            name = name if name in node.children or len(node.children) < fanout else None
            node = node.children.setdefault(name, Node())
            path.append(node)
        if not noted and limit is not None and len(node.own) >= limit:
            continue
        known.add(page)
        node.own_seen += 1
        node.own_taken += noted
        for n in path:
            n.taken += noted
            n.waiting += not noted
        if not noted:
            node.own.append((url, seq))
    out = []
    while any(c.waiting for c in root.children.values()):
        node, path = root, []
        while True:
            ways = [(c.taken, 1, i, c) for i, c in enumerate(node.children.values()) if c.waiting]
            if node.own:
                ways.append((node.own_taken / min(node.own_seen, fanout), 0, 0, None))
            _, _, _, child = min(ways, key=lambda w: w[:3])
            if child is None:
                break
            path.append(child)
            node = child
        out.append(node.own.pop(0))
        node.own_taken += 1
        for n in path:
            n.taken += 1
            n.waiting -= 1
    return out


def spread(spark, events, **options):
    of = lambda noted: spark.createDataFrame([(u, s) for s, u, n in events if n == noted], "url string, seq long")
    got = scheduling.spread(of(False), of(True), **options).collect()
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1))
    return [(r.url, r.seq) for r in sorted(got, key=lambda r: r.place)]


@pytest.mark.parametrize(("seed", "limit"), [(1, None), (2, None), (3, 4)])
def test_spread_is_the_order_of_picks(spark, seed, limit):
    r = random.Random(seed)
    directory = lambda: "/".join(str(min(r.randint(0, 60), r.randint(0, 60))) for _ in range(r.randint(0, 3)))
    urls = [f"https://h{min(r.randint(0, 2), r.randint(0, 2))}.example:{r.choice(['', '8080'])}".rstrip(":") + f"/{directory()}/{r.randint(0, 30)}{r.choice(['', '?q=1', '#f', '/'])}" for _ in range(500)]
    events = [(i, u, r.random() < 0.1) for i, u in enumerate(urls)] + [(501, None, False), (502, "https://h0.example/*/x", False), (503, "https://h0.example", False)]
    if limit:
        events = [(s, u, False) for s, u, _ in events]
    assert spread(spark, events, limit=limit) == picked(events, limit)


def test_query_in_the_order_of_picks(spark):
    rows = pq.read_table(f"{DATA}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    want = picked([(r["page_id"], r["url"], r["page_id"] % 9 == 4) for r in rows])
    got = sorted(crawling.diverse_order(spark, DATA).collect(), key=lambda r: r.place)
    assert [(r.url, r.seq) for r in got] == want
    empty = spark.createDataFrame([], "url string, seq long")
    assert scheduling.spread(empty).columns == ["url", "seq", "place"] and scheduling.spread(empty).count() == 0


def test_groups_settle_on_what_is_seen_first(spark):
    seen = {"a": "TTTF", "b": "TTF", "c": "FTTT", "d": "TT", "e": "TFTTT", "f": "NTNTNTF", "g": "NN", "h": "T" * 500}
    rows = [(g, i, {"T": True, "F": False, "N": None}[x]) for g, xs in seen.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "group string, seq long, same boolean").repartition(7)
    modes = scheduling.settled_modes(df)
    assert {r.group: (r.mode, r.at, r.agreed) for r in modes.collect()} == {
        "a": ("http", 2, 3), "b": ("browser", 2, 2), "c": ("browser", 0, 0), "d": ("adaptive", None, 2), "e": ("browser", 1, 1), "f": ("http", 5, 3), "h": ("http", 2, 3),
    }
    got = defaultdict(list)
    for r in sorted(scheduling.routes(df.select("group", "seq").unionByName(spark.createDataFrame([("new", 0)], "group string, seq long")), modes).collect(), key=lambda r: r.seq):
        got[r.group].append((r.mode, r.detects))
    assert got["a"] == [("browser", True)] * 3 + [("http", False)] and got["e"] == [("browser", True)] * 3 + [("browser", False)] * 2
    assert got["d"] == [("browser", True)] * 2 and got["new"] == got["g"][:1] == [("http", False)] and len(got["h"]) == 500


def test_pages_that_read_the_same(spark):
    schema = "title string, lang string, canonical string, h1 array<string>, meta map<string,string>, property map<string,string>, links struct<internal: array<string>>"
    base = ("t", "en", None, ["h"], {"a": "1", "b": "2"}, {}, (["/x", "/y"],))
    live = [base, (*base[:4], {"b": "2", "a": "1"}, {}, (["/y", "/x"],)), ("u", *base[1:]), (*base[:6], (["/x"],)), (*base[:2], "/c", *base[3:]), None]
    df = spark.createDataFrame([(i, base, x) for i, x in enumerate(live)] + [(9, None, None)], f"i int, s struct<{schema.replace(' ', ': ', 0)}>, l struct<{schema}>")
    got = {r.i: r.same for r in df.select("i", scheduling.reads_same(F.col("s"), F.col("l")).alias("same")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 9: True}


def test_places_within_groups(spark):
    rows = [("hot" if i % 3 else None if i % 2 else "b", (i * 7919) % 1000, i) for i in range(1000)]
    got = ranking.place_within(spark.createDataFrame(rows, "g string, v long, i long").repartition(5), ["g"], [F.desc("v"), F.col("i")]).collect()
    for g in ("hot", None, "b"):
        of = sorted((r for r in got if r.g == g), key=lambda r: (-r.v, r.i))
        assert [r.place for r in of] == list(range(1, len(of) + 1))
    every = ranking.place_within(spark.createDataFrame(rows, "g string, v long, i long"), [], [F.col("i")]).collect()
    assert all(r.place == r.i + 1 for r in every) and every[0].asDict().keys() == {"g", "v", "i", "place"}
