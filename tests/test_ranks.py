"""Ranks of groups of any size, and texts with equal terms."""

import random

from pyspark.sql import functions as F

from parlance.operators import ranks, tfidf


def test_ranked(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, 1.0, 2.0, 3.0]), i, "x") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double, id bigint, _n string")
    got = {r["id"]: (r["k"], r["size"]) for r in ranks.ranked(df.repartition(5), ["g"], ["v", "id"], "k", "size").collect()}
    want = {}
    for g in ("hot", "a", None):
        mine = sorted(((v is not None, v or 0.0, i) for h, v, i, _ in rows if h == g))
        want |= {i: (k, len(mine)) for k, (_, _, i) in enumerate(mine, 1)}
    assert got == want and ranks.ranked(df.limit(0), ["g"], ["v", "id"], "k").count() == 0


def test_equal_texts(spark):
    texts = ["b a a", "a b a", "a b", None, "", "a b a c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    counts = tfidf.term_counts(df, "id", F.filter(F.split("text", " "), lambda w: w != ""))
    assert {r["id"]: r["rep"] for r in tfidf.equal_texts(counts, "id").collect()} == {0: 0, 1: 0, 2: 2, 5: 5}
