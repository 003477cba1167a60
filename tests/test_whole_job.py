"""Queries on all of their rows, against brute force."""

from collections import defaultdict
from datetime import timedelta
from unittest.mock import MagicMock

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagesift.functions import headers
from pagesift.operators import graph, mail
from pagesift.plans import relations

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events():
    return pq.read_table(f"{DATA}/events.parquet", columns=["event_id", "ts", "user_id"]).to_pylist()


@pytest.fixture(scope="module")
def out(events):
    """The targets of each user, whoever has any."""
    order = [r["user_id"] for r in sorted(events, key=lambda r: (r["ts"], r["event_id"]))]
    found = defaultdict(set)
    for a, b in zip(order, order[1:]):
        if a != b:
            found[a].add(b)
    return found


def test_graph_has_every_link(spark, out):
    into = defaultdict(int)
    for targets in out.values():
        for t in targets:
            into[t] += 1
    nodes = set(out) | set(into)
    assert {(r.src, r.dst) for r in relations.graph_edges(spark, DATA).collect()} == {(a, b) for a, targets in out.items() for b in targets}
    assert {r.node: (r.in_degree, r.out_degree) for r in relations.graph_degrees(spark, DATA).collect()} == {n: (into[n], len(out.get(n, ()))) for n in nodes}
    depth = frontier = {min(out): 0}
    while frontier:
        frontier = {t: d + 1 for n, d in frontier.items() for t in out.get(n, ()) if t not in depth}
        depth = depth | frontier
    assert {r.node: r.depth for r in relations.graph_bfs_depth(spark, DATA).collect()} == depth


def test_graph_ranks_settle(spark, out):
    nodes = set(out).union(*out.values())
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        held = sum(r for n, r in rank.items() if n not in out)
        step = dict.fromkeys(nodes, (0.15 + 0.85 * held) / len(nodes))
        for n, targets in out.items():
            for t in targets:
                step[t] += 0.85 * rank[n] / len(targets)
        moved = sum(abs(step[n] - rank[n]) for n in nodes)
        rank = step
        if moved < 1e-9:
            break
    got = {r.node: r["rank"] for r in relations.graph_pagerank(spark, DATA).collect()}
    assert got == pytest.approx({n: r * len(nodes) for n, r in rank.items()}, abs=6e-4)


def test_every_order_is_a_reference(spark):
    orders = pq.read_table(f"{DATA}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist()
    keys = {r["s_suppkey"] for r in pq.read_table(f"{DATA}/supplier.parquet", columns=["s_suppkey"]).to_pylist()}
    refs = [(f"c{o['o_custkey']}", o["o_orderkey"] % 90, o["o_orderkey"] % 7) for o in orders]
    want = sorted((page, f"s{k}#{n}") for page, k, n in refs if k in keys and n != k % 3)
    assert sorted((r.page, r.id) for r in relations.jsonld_reference_broken(spark, DATA).collect()) == want


def test_every_event_is_an_interval(spark, events):
    by_user = defaultdict(list)
    for r in events:
        by_user[r["user_id"]].append(r)
    want = sorted((r["event_id"], s["event_id"]) for of in by_user.values() for r in of for s in of if s["ts"] <= r["ts"] < s["ts"] + timedelta(hours=2))
    assert sorted((r.event_id, r.span) for r in relations.interval_join(spark, DATA).collect()) == want


def test_depths_has_no_last_level(spark, monkeypatch):
    """1,200 levels, of frames that hold nothing: only the rounds are counted."""
    rounds = iter([*[1] * 1200, 0])
    frame = MagicMock()
    for verb in ("select", "distinct", "join", "withColumn", "unionByName", "limit"):
        getattr(frame, verb).return_value = frame
    frame.count.side_effect = lambda: next(rounds)
    monkeypatch.setattr(graph, "cut", lambda df: df)
    graph.depths(frame, frame)
    assert next(rounds, None) is None


def test_depths_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(7, 0)], "src int, dst int")
    seed = e.where("src = 0").select(F.col("src").alias("node"))
    assert {r.node: r.depth for r in graph.depths(e, seed).collect()} == {i: i for i in range(8)}


def test_long_spf_record(spark):
    records = spark.createDataFrame([("d", "v=spf1 " + "ip4:192.0.2.1 " * 600 + "a mx -all")], "name string, record string")
    assert mail.spf_walk(spark.createDataFrame([("d",)], "domain string"), records).collect() == [("d", 2, True)]


def test_long_content_policy(spark):
    policy = "img-src " + " ".join(f"h{i}" for i in range(1200))
    row = spark.createDataFrame([(policy,)], "h string").select(F.size(headers.content_policy(F.col("h"))["img-src"]).alias("n")).first()
    assert row.n == 1200


def test_many_content_policies(spark):
    limits = spark.range(1).select(F.expr("concat(array_repeat(map('img-src', array('a', 'b')), 1100), array(map('img-src', array('b'))))").alias("p"))
    assert limits.select(headers.effective_sources(F.col("p"), "img-src").alias("s")).first().s == ["b"]
