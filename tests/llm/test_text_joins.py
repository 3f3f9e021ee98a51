"""Shared spans, leaks, near duplicates and history against brute force, on hostile small inputs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import hashing, history, leaks, neardup, spans, trie

WORD = re.compile(r"[^\W_]+")


def fold(t):
    return WORD.findall((t or "").lower())


def runs(t, k, least=20):
    w = fold(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= least else set()


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 120))) for _ in range(n // 3)]
    out = [None, "", "   \n\t", "short one", "x" * 20000, "a " * 300]
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 2)] = [rng.choice(vocab) for _ in range(rng.randint(0, 2))]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    # A third of all rows are copies of one text.
    return out + [base[0]] * (len(out) // 2)


def table(spark, texts, key="id"):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], f"{key} bigint, text string, n string, doc bigint").repartition(3)


def test_shared_words(spark):
    texts = corpus()
    own, shared = {}, set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        for j in range(len(w) - 39):
            g = tuple(w[j : j + 40])
            if own.setdefault(g, i) != i:
                shared.add(g)
    want = {}
    for i, t in enumerate(texts):
        w, marked = (t or "").split(), set()
        for j in range(len(w) - 39):
            if tuple(w[j : j + 40]) in shared:
                marked.update(range(j, j + 40))
        if marked:
            want[i] = len(marked)
    assert {r[0]: r[1] for r in spans.shared_words(table(spark, texts), "id", "text").collect()} == want
    assert want and spans.shared_words(table(spark, []), "id", "text").count() == 0


def test_leaks(spark):
    texts = corpus(60, 2)
    items = [texts[10], None, "", "too short", texts[10], " ".join(fold(texts[20])[:30])]
    want = set()
    for k, item in enumerate(items):
        mine = runs(item, 10, 0)
        want |= {(i, k) for i, t in enumerate(texts) if mine & runs(t, 10, 0)}
    docs = table(spark, texts, "doc_id")
    got = {tuple(r)[:2] for r in leaks.find_leaks(docs, table(spark, items, "item_id")).collect()}
    assert got == want and want
    assert leaks.find_leaks(docs, table(spark, [], "item_id")).count() == 0


def test_leaks_with_edits(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = ["say alpha beta gamma delta EXTRA epsilon zeta eta theta iota kappa now", item.replace("eta ", "other "), item.replace("zeta", "b").replace("iota", "c"), item]
    got = {tuple(r) for r in leaks.find_leaks(table(spark, docs, "doc_id"), table(spark, [item], "item_id"), edits=1).collect()}
    assert {(d, e) for d, _, e in got} == {(0, 1), (3, 0)}


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=20))
@settings(max_examples=150, deadline=None)
def test_myers(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    assert leaks.myers(p, t) == min(row)


@pytest.mark.parametrize("n", [3, 40, 400])
def test_trie_join(n):
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 1 << 63, size=(n, 2)).astype(np.uint64)
    bits[n // 2 :] = bits[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 64, size=(n - n // 2, 2)).astype(np.uint64))
    errors, size = rng.integers(0, 3, n), rng.integers(5, 40, n)
    # Two roots of their own, and the pair of them.
    order = np.concatenate([np.lexsort(bits[:n // 3].T[::-1]), n // 3 + np.lexsort(bits[n // 3 :].T[::-1])])
    bits, errors, size = bits[order], errors[order], size[order]
    p, q = np.array([0, 1, 0]), np.array([0, 1, 1])
    a, b = trie.join(bits, np.array([0, n // 3]), np.array([n // 3, n]), p, q, errors, size, 0.25)
    found = [tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)]
    got = set(found)
    assert len(got) == len(found)
    dist = lambda i, j: sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(bits[i], bits[j], strict=True))
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if errors[i] + errors[j] + dist(i, j) <= 0.25 * (size[i] + size[j]) + 1e-9}


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.6), (5, 0.8)])
def test_near_pairs(spark, k, threshold, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = corpus(90, 3)
    sets = {i: s for i, t in enumerate(texts) if (s := runs(t, k))}
    ids = sorted(sets)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}
    got = [tuple(r) for r in neardup.near_pairs(table(spark, texts), threshold=threshold, k=k).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    rows = {r["id"]: r for r in neardup.near_classes(table(spark, texts), threshold=threshold, k=k).collect()}
    assert set(rows) == set(sets)
    for i in ids:
        equal = [j for j in ids if sets[j] == sets[i]]
        assert rows[i]["class_id"] == min(equal) and rows[i]["n_copies"] == len(equal)
        near = {frozenset(sets[j]) for j in ids if sets[j] != sets[i] and ((min(i, j), max(i, j)) in want)}
        assert rows[i]["n_links"] == len(near)


def test_near_pairs_of_nothing(spark):
    assert neardup.near_pairs(table(spark, [])).count() == 0
    assert neardup.near_pairs(table(spark, [None, "", "one two"])).count() == 0


def test_history(spark, tmp_path):
    texts = corpus(100, 4)
    rng = random.Random(5)
    rng.shuffle(texts)
    old, new = texts[:60], texts[60:]
    paths = [rng.choice(["/a/./b.json", "\\a\\c.json", "/x/../d.json", None, *[f"/n/{i}/{k}" for k in range(16)]]) for i in range(len(new))]
    rows = [(i, i // 12, paths[i], t, "extra") for i, t in enumerate(new)]
    items = spark.createDataFrame(rows, "item_id bigint, batch_no int, file_path string, text string, path string")
    h = history.History(spark, f"file://{tmp_path}/h", 0.6, 3)
    h.add_texts(table(spark, old), "id", "text")
    h.add_files(spark.createDataFrame([("/a//b.json",), (None,)], "file_path string"), "file_path")
    got = {(r[0], r[1]): r[2] for r in h.decide(items).collect()}
    exact, near = {t.strip() for t in old if t is not None}, [s for t in old if (s := runs(t, 3))]
    files, pending, current, want = {"/a/b.json"}, set(), None, {}
    for i, batch, path, t, _ in rows:
        if batch != current:
            files |= pending
            pending, current = set(), batch
        p = history.resolve(path)
        if p is not None:
            pending.add(p)
        s = runs(t, 3)
        if p is not None and p in files:
            want[batch, i] = "file"
        elif t is not None and t.strip() in exact:
            want[batch, i] = "exact"
        elif s and any(len(s & x) >= 0.6 * len(s | x) for x in near):
            want[batch, i] = "near"
        else:
            want[batch, i] = "accepted"
            if t is not None:
                exact.add(t.strip())
            if s:
                near.append(s)
    assert got == want and len(set(want.values())) == 4
    # What was accepted is history for the next call; texts of repeated files were never accepted.
    h.accept(items, h.decide(items))
    again = h.decide(items.filter("text IS NOT NULL").withColumn("file_path", F.lit(None).cast("string"))).collect()
    assert {r["verdict"] for r in again if want[r[0], r[1]] == "accepted"} == {"exact"}
    empty = history.History(spark, f"file://{tmp_path}/none", 0.6, 3)
    assert empty.decide(items.limit(0)).count() == 0


def test_accepted_items_with_ids_of_old_texts(spark, tmp_path):
    """Items and old texts may have one id: leaving out a copy of an old text leaves the accepted item of its id in the history."""
    first, second = (" ".join(f"{w}{i}" for i in range(40)) for w in ("old", "new"))
    h = history.History(spark, f"file://{tmp_path}/h", 0.6, 3)
    h.add_texts(spark.createDataFrame([(6, first), (7, first + "."), (8, first + "!")], "id bigint, text string"), "id", "text")
    schema = "item_id bigint, batch_no int, file_path string, text string"
    items = spark.createDataFrame([(7, 1, None, second)], schema)
    verdicts = h.decide(items)
    assert [r["verdict"] for r in verdicts.collect()] == ["accepted"]
    h.accept(items, verdicts)
    later = spark.createDataFrame([(1, 2, None, second.replace("new20", "other")), (2, 2, None, first.replace("old20", "other")), (3, 2, None, " ".join(f"third{i}" for i in range(40)))], schema)
    assert {r["item_id"]: r["verdict"] for r in h.decide(later).collect()} == {1: "near", 2: "near", 3: "accepted"}


def test_batch_by_batch(spark, tmp_path, monkeypatch):
    """Batches decided at once give what they give one after the other, each accepted before the next; salts and orders that grow."""
    monkeypatch.setattr(history, "SALT", 3)
    texts = corpus(120, 6)
    random.Random(7).shuffle(texts)
    rows = [(i, i // 20, f"/f/{i % 50}", t) for i, t in enumerate(texts[40:])]
    items = spark.createDataFrame(rows, "item_id bigint, batch_no int, file_path string, text string")
    once, steps = (history.History(spark, f"file://{tmp_path}/{n}", 0.6, 3, buckets=4) for n in ("once", "steps"))
    for h in (once, steps):
        h.add_texts(table(spark, texts[:40]), "id", "text")
    want = {tuple(r) for r in once.decide(items).collect()}
    got = set()
    for k in range(1 + max(r[1] for r in rows)):
        batch = items.filter(F.col("batch_no") == k)
        verdicts = steps.decide(batch)
        found = [tuple(r) for r in verdicts.collect()]
        steps.accept(batch, spark.createDataFrame(found, verdicts.schema))
        got |= set(found)
    assert got == want and len({v for _, _, v in want}) == 4


def test_history_is_not_shuffled(spark, tmp_path):
    """The history's side of the joins is read in its buckets: no exchange lies between its scan and the join."""
    h = history.History(spark, f"file://{tmp_path}/h", 0.6, 3, buckets=4)
    h.add_texts(table(spark, corpus(40, 8)), "id", "text")
    new = spark.createDataFrame([(bytes(16),)], "hash binary").hint("merge")
    plan = new.join(h.table("content"), "hash", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_heavy_keys(spark):
    """Bounded summaries hold every frequent key, with no count above the true one."""
    df = spark.range(20000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN 9 ELSE id END AS k").repartition(7)
    keys, n = hashing.heavy(df, lambda b: b.column("k").to_numpy(zero_copy_only=False).astype(np.uint64), k=16)
    found = dict(zip(keys.tolist(), n.tolist(), strict=True))
    assert set(found) == {7, 9} and 6667 * 0.8 <= found[7] <= 6667 and 2667 * 0.5 <= found[9] <= 2667
    assert hashing.counts_of((keys, n), np.array([7, 8], dtype=np.uint64)).tolist() == [found[7], 0]
    assert len(hashing.heavy(df.limit(0), lambda b: np.zeros(0, dtype=np.uint64))[0]) == 0


def test_rows_sent_are_the_prefixes(spark, monkeypatch):
    """Whatever the summary holds, one row is sent per member of a prefix, and pairs are the same."""
    texts = corpus(90, 3)
    want = sorted(tuple(r) for r in neardup.near_pairs(table(spark, texts), threshold=0.6, k=3).collect())
    monkeypatch.setattr(neardup, "frequent_members", lambda sets: hashing.heavy(sets.select("n", "set"), lambda b: hashing.mix(neardup._members(b)[1]), k=2))
    sets = neardup.text_sets(table(spark, texts), "id", "text", 3, 20)
    sent = sum(len(r["key"]) // 6 for r in neardup.roots(sets, 0.6).collect())
    assert sent == sum(r["n"] - -(-r["n"] * 6 // 10) + 1 for r in sets.collect())
    assert sorted(tuple(r) for r in neardup.near_pairs(table(spark, texts), threshold=0.6, k=3).collect()) == want
