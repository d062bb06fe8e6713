"""Queries over whole texts and whole tables against brute force on the driver's smallest tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest

from helioscope.operators import graph, overlaps
from helioscope.plans import registry


def rows(sf_dir, sql):
    return duckdb.sql(re.sub(r"\{(\w+)\}", lambda m: f"'{sf_dir}/{m[1]}.parquet'", sql)).fetchall()


def similarities(sets):
    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n:
            yield a, b, n, n / len(sets[a] | sets[b])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_graph_jaccard(spark, sf_dir):
    near = defaultdict(set)
    for c, s in rows(sf_dir, "SELECT o_custkey, 1000000 + l_suppkey FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"):
        near[c].add(s)
        near[s].add(c)
    got = {(r["a"], r["b"]): (r["common"], r["jaccard"]) for r in registry.QUERIES["graph_jaccard"](spark, sf_dir).collect()}
    want = {(a, b): (n, pytest.approx(x, abs=1e-6)) for a, b, n, x in similarities(near)}
    assert got == want and len({b for _, b in got if b > 1000000}) > 1


def test_levenshtein_whole(spark, sf_dir):
    texts = [(i, re.sub("[^a-z ]", "", t.lower())) for i, t in rows(sf_dir, "SELECT item_id, text FROM {benchmark} ORDER BY 1")][:12]
    got = {r["item_id"]: r["distance"] for r in registry.QUERIES["levenshtein_benchmark"](spark, sf_dir).collect()}
    assert max(len(t) for _, t in texts) > 40
    assert [got[i] for i, _ in texts] == [None, *(distance(a, b) for (_, a), (_, b) in zip(texts, texts[1:]))]


def test_skip_grams_and_jaccard_of_documents(spark, sf_dir):
    words = {i: re.findall("[a-z]+", t.lower()) for i, t in rows(sf_dir, "SELECT doc_id, text FROM {documents}")}
    want = Counter((i, f"{w[k]} {w[k + d]}") for i, w in words.items() for d in (1, 2) for k in range(len(w) - d))
    assert {(r["doc_id"], r["pair"]): r["n"] for r in registry.QUERIES["skip_grams_documents"](spark, sf_dir).collect()} == want
    got = {(r["a"], r["b"]): r["jaccard"] for r in registry.QUERIES["jaccard_document_pairs"](spark, sf_dir).collect()}
    assert got == {(a, b): pytest.approx(x, abs=1e-6) for a, b, _, x in similarities({i: set(w) for i, w in words.items()})}


def test_cusum_at_the_threshold(spark, tmp_path):
    duckdb.sql("CREATE OR REPLACE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 1 MINUTE AS ts, u AS user_id, v::DOUBLE AS value FROM (VALUES (1, 7, 14.16), (2, 7, 3.51), (3, 7, 17.33), (4, 8, 155.01), (5, NULL, 300)) t(i, u, v)")
    duckdb.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    want = duckdb.sql(registry.ORACLES["cusum_holt_by_user"]).fetchall()
    duckdb.sql("DROP TABLE events")
    got = [tuple(r) for r in registry.QUERIES["cusum_holt_by_user"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {u: a for u, a, _ in got} == {7: 0, 8: 1}


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("block", [40, 1 << 21])
def test_similarity_moves_no_pairs(spark, monkeypatch, kind, block):
    monkeypatch.setattr(overlaps, "BLOCK", block)  # links a range of sources
    draw = random.Random(3)
    links = [(kind(draw.randrange(60)), kind(int(draw.paretovariate(0.7)) % 50)) for _ in range(400)]  # some of them twice
    hot = [(kind(900 + i), kind(77)) for i in range(40)]
    sets = defaultdict(set)
    for a, b in links + hot:
        sets[a].add(b)
    t = {int: "bigint", str: "string"}[kind]
    df = graph.neighbour_similarity(spark.createDataFrame(links + hot + [(None, kind(77)), (kind(5), None)], f"src {t}, dst {t}"), 6)
    want = {(a, b): (n, pytest.approx(x, abs=1e-6)) for a, b, n, x in similarities(sets)}
    rows = df.collect()
    assert {(r["a"], r["b"]): (r["common"], r["jaccard"]) for r in rows} == want and len(rows) == len(want)
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", [int, str])
def test_similarity_moves_a_block_once(spark, monkeypatch, kind):
    monkeypatch.setattr(overlaps, "BLOCK", 40)
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def moved():  # rows that stages wrote for a shuffle
        x = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(x.apply(i).shuffleWriteRecords() for i in range(x.size()))

    links = [(i, kind(j)) for i in range(60) for j in (i % 7, 7 + i % 11, 20)]  # five blocks or more, all of which meet
    df = graph.neighbour_similarity(spark.createDataFrame(links, f"src bigint, dst {'string' if kind is str else 'bigint'}"))
    blocks = spark.read.parquet(*df.inputFiles()).count()
    before = moved()
    assert len(df.collect()) == 60 * 59 // 2
    assert 5 <= blocks and blocks <= moved() - before <= 2 * blocks
