"""The SQL of the operators, and the pipeline against a brute-force version of its stages."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from pagesift.llm import mixing, quality, registry
from pagesift.llm.common import table
from pagesift.llm.piece_encoding import default_model
from pagesift.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline_against_brute_force(spark):
    import sentencepiece

    import corpus_pipeline

    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    docs, labels = table(spark, SF, "documents").toPandas(), table(spark, SF, "labels").toPandas()
    held = set(r.doc_id for r in table(spark, SF, "documents").where(quality.held_out()).collect())
    stats = {int(i): quality.statistics(t) for i, t in zip(docs.doc_id, docs.text)}
    sums = {}
    for k in (0, 1):
        x = np.array([stats[i] for i, q in zip(labels.doc_id, labels.quality) if q == k and i in stats and i not in held]).reshape(-1, quality.DIMENSIONS)
        sums[k] = (float(len(x)), x.sum(0), x.T @ x)
    model = quality.fit(sums)
    rows = [r for r in docs.itertuples() if model.score(stats[r.doc_id])[0] >= quality.THRESHOLD]
    best = {}
    for r in rows:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    rows = [r for r in rows if best[r.text] == r.doc_id]
    sets = {r.doc_id: set(shingle_set(r.text).tolist()) for r in rows}
    name = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((name[i], name[j]))
                name = {k: a if v == b else v for k, v in name.items()}
    left = spark.createDataFrame([(r.doc_id, r.text, r.source) for r in rows if name[r.doc_id] == r.doc_id], "doc_id long, text string, source string").toPandas()
    con = duckdb.connect()
    con.register("docs", left)
    copies = dict(con.sql("WITH " + mixing.MIX_SQL + " SELECT doc_id, copies FROM taken").fetchall())
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in left.itertuples():
        ids = lib.encode(r.text)
        if copies[r.doc_id]:
            want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))] += copies[r.doc_id]
    assert got == want
