"""Core operators against brute force, on hostile small inputs."""

import json
import math
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import features, rewriting, text
from parlance.operators import graph, patterns, periods, sessions, shred, stores, tfidf, timestamps

# Timestamps ---------------------------------------------------------------------------------------------------------------------
BERLIN, INSTANTS = "Europe/Berlin", [
    ("2025-02-10 00:44:33", "2025-02-09T23:44:33Z"),
    (' "2026-03-18 12:52:02"\n', "2026-03-18T11:52:02Z"),
    ("2024-04-19T14:34", "2024-04-19T12:34:00Z"),
    ("2024-09-09", "2024-09-08T22:00:00Z"),
    ("2024-04-26t22:43:02.260z", "2024-04-26T22:43:02.260Z"),
    ("2024-02-29T22:50:11.368180899Z", "2024-02-29T22:50:11.368180Z"),
    ("2025-10-11 22:54:30,263", "2025-10-11T20:54:30.263Z"),
    ("20240502T103612Z", "2024-05-02T10:36:12Z"),
    ("2026-01-22T19:55:46.651+0900", "2026-01-22T10:55:46.651Z"),
    ("2026-08-21T16:12:24-04", "2026-08-21T20:12:24Z"),
    ("2025-08-14T17:58:52+05:30[Asia/Kolkata]", "2025-08-14T12:28:52Z"),
    ("2025-01-22 09:12:00 IST", "2025-01-22T03:42:00Z"),
    ("2025-10-07 14:36:49 BST", "2025-10-07T13:36:49Z"),
    ("Mon, 15 Apr 2024 12:33:51 +0900", "2024-04-15T03:33:51Z"),
    ("Sep 19, 2025 4:06:42 AM", "2025-09-19T02:06:42Z"),
    ("24 March 2026, 14:31:12", "2026-03-24T13:31:12Z"),
    ("10/27/2025 09:20:23", "2025-10-27T08:20:23Z"),
    ("8/27/2026 12:29 pm", "2026-08-27T10:29:00Z"),
    ("8/27/2026 12:29 am", "2026-08-26T22:29:00Z"),
    ("30.11.2024 06:30:46", "2024-11-30T05:30:46Z"),
    # A doubled local time is the earlier instant; a skipped one has the offset before the change.
    ("2025-10-26 02:30:00", "2025-10-26T00:30:00Z"),
    ("2025-03-30 02:30:00", "2025-03-30T01:30:00Z"),
    ("1783718610232", "2026-07-10T21:23:30.232Z"),
    ("1.744925010251E9", "2025-04-17T21:23:30.251Z"),
    ("1778652886", "2026-05-13T06:14:46Z"),
    ("1787344438459601", "2026-08-21T20:33:58.459601Z"),
    ("1707548326781260934", "2024-02-10T06:58:46.781260Z"),
    *[(x, None) for x in (None, "", " ", "n/a", "NaN", "yesterday", "T12:00:00Z", "2024-11-", "31.06.2025 09:15:00", "2025-13-04T08:00:00Z", "2025-05-17 25:10:00", "2025-02-30", "0000-00-00 00:00:00", "12", "1e99", "9" * 60, "2025-01-01 10", "2025-01-01 10:00 XYZ", "13/27/2025")],
]


def micros(iso):
    d = datetime.fromisoformat(iso)
    return (d - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def test_instants(spark):
    df = spark.createDataFrame([(i, r, BERLIN, 1) for i, (r, _) in enumerate(INSTANTS)], "id int, raw string, zone string, utc_us int")
    got = {r["id"]: r["utc_us"] for r in timestamps.with_instant(df).collect()}
    assert {i: got[i] for i in got} == {i: None if u is None else micros(u) for i, (_, u) in enumerate(INSTANTS)}


def test_unknown_zones(spark):
    rows = [(1, "2025-01-01 10:00:00[Nowhere/Land]", BERLIN), (2, "2025-01-01 10:00:00", "no zone"), (3, "2025-01-01 10:00:00", None), (4, "2025-01-01 10:00:00Z", "no zone"), (5, "2025-01-01 10:00:00[Asia/Tokyo]", BERLIN)]
    got = {r["id"]: r["utc_us"] for r in timestamps.with_instant(spark.createDataFrame(rows, "id int, raw string, zone string")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: micros("2025-01-01T10:00:00Z"), 5: micros("2025-01-01T01:00:00Z")}


def test_local_times_match_zoneinfo(spark):
    rng = random.Random(1)
    rows = [(i, (datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(1_400_000))).strftime("%Y-%m-%d %H:%M:%S"), rng.choice(["America/New_York", "Australia/Sydney", "Europe/London", "Asia/Tokyo"])) for i in range(2000)]
    got = {r["id"]: r["utc_us"] for r in timestamps.with_instant(spark.createDataFrame(rows, "id int, raw string, zone string")).collect()}
    for i, raw, zone in rows:
        assert got[i] == micros(datetime.fromisoformat(raw).replace(tzinfo=ZoneInfo(zone)).isoformat())


def test_dictionary_grows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/d"
    rows = lambda *raw: spark.createDataFrame([(i, r, BERLIN) for i, r in enumerate(raw)], "id int, raw string, zone string")
    assert timestamps.normalise(rows("2025-01-01", "2025-01-01", "x", None), path).count() == 2
    assert timestamps.normalise(rows("2025-01-01", "2025-01-02"), path).count() == 2
    assert spark.read.parquet(path).groupBy("raw").count().filter("count > 1").count() == 0
    assert timestamps.normalise(rows("2025-01-01").limit(0)).count() == 0


# Shredding ------------------------------------------------------------------------------------------------------------------------
json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=4), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), v, max_size=3), max_leaves=12)


@given(json_values)
@settings(max_examples=300, deadline=None)
def test_shredded_leaves(value):
    def leaves(v, path=""):
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in leaves(y, f"{path}.{k}" if path else k)]
        if isinstance(v, list):
            return [x for y in v for x in leaves(y, path + "[]")]
        return [] if v is None else [(path, v if isinstance(v, str) else json.dumps(v))]

    got = []
    for path, ordinals, held in shred.rows(json.dumps(value)):
        assert path.count("[]") == len(ordinals)
        got += [(f"{path}.{k}" if path and k else path + k, v) for k, v in held.items()]
    assert sorted(got) == sorted(leaves(value))


@pytest.mark.parametrize("bad", [None, "", "[", '[{"a": 1}', '{"a" 1}', "[1,]", "[1 2]", "nul", '{"a": 1} x', "[" * 5000])
def test_damaged_json(bad):
    assert shred.rows(bad) == []


def test_shred_tables(spark):
    rows = [(1, '{"k1": {"p": "root", "xs": ["a", null]}, "k2": null}', 5), (2, None, 6), (3, "[]", 7)]
    df = spark.createDataFrame(rows, "id bigint, doc string, path int")
    out = shred.shred(df, F.col("doc"), ["id"], maps=("",), inherit={"{}": ("p",)})
    got = {(r["id"], r["path"], tuple(r["ordinals"])): r["leaves"] for r in out.collect() if r["path"]}
    assert got == {(1, "{}", ("k1",)): {"p": "root"}, (1, "{}", ("k2",)): {}, (1, "{}.xs[]", ("k1", "0")): {"": "a", "{}.p": "root"}, (1, "{}.xs[]", ("k1", "1")): {"{}.p": "root"}}
    assert shred.table(out, "{}.xs[]", ["id"], {"x": ""}).count() == 2


# Stores ---------------------------------------------------------------------------------------------------------------------------
def test_stores(spark):
    store = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, None)], "id int, k string, ref int")
    rows = spark.createDataFrame([(10, "a", 0), (11, "c", 0), (12, "c", 0), (13, None, 0), (14, None, 0)], "id int, k string, extra int")
    assert sorted(r["id"] for r in stores.insert_if_absent(store, rows, "k", ["id"]).collect()) == [11, 13, 14]
    up = stores.upsert(store, rows, ["k"], ["id"], keep=("id",)).collect()
    assert sorted((r["k"] or "", r["id"]) for r in up) == [("", 3), ("", 14), ("a", 1), ("b", 2), ("c", 12)]
    old = spark.createDataFrame([(1, None, 5), (2, 1, 50), (3, 2, None)], "id int, ref int, at int")
    assert sorted((r["id"], r["ref"]) for r in stores.purge(old, "id", "ref", "at", F.lit(10)).collect()) == [(2, None), (3, 2)]
    assert stores.insert_if_absent(store.limit(0), rows.limit(0), "k", ["id"]).count() == 0


def test_first_per_key_plan_limits_before_the_shuffle(spark):
    df = stores.first_per_key(spark.range(100).selectExpr("id", "id % 3 AS k"), ["k"], ["id"])
    assert "WindowGroupLimit" in df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 2]


# Sessions -------------------------------------------------------------------------------------------------------------------------
def loops_by_hand(steps):
    out, used, i = [], set(), 0
    while i + 3 < len(steps):
        a, b = steps[i], steps[i + 1]
        n = 1
        while a != b and steps[i + 2 * n : i + 2 * n + 2] == [a, b]:
            n += 1
        if a != b and n >= 2:
            out.append((i + 1, i + 2 * n, n, f"{a}->{b}"))
            used |= set(range(i, i + 2 * n))
            i += 2 * n
        else:
            i += 1
    i = 0
    while i < len(steps):
        j = i + 1
        while i not in used and j < len(steps) and steps[j] == steps[i] and j not in used:
            j += 1
        if i not in used and j - i >= 3:
            out.append((i + 1, j, j - i, steps[i]))
        i = j
    return out


def test_loops(spark):
    rng = random.Random(3)
    runs = {s: [rng.choice("ABC" if s % 3 else "AB") for _ in range(rng.randint(0, 40))] for s in range(120)}
    runs[500] = list("ABABABABAB" * 3 + "AAAA" + "BABABCBCBCB")
    rows = [(s, i, x, i) for s, steps in runs.items() for i, x in enumerate(steps)]
    rows += [(900, 0, None, 0)]
    got = {tuple(r) for r in sessions.loops(spark.createDataFrame(rows, "s int, i int, step string, idx int").repartition(3), "s", ["i"], "step", "idx").collect()}
    assert got == {(s, *x) for s, steps in runs.items() for x in loops_by_hand(steps)}


def test_quality_and_frustration(spark):
    df = spark.createDataFrame([(1.0, None, None, 0.5), (None, None, None, None)], "prompt double, efficiency double, focus double, outcome double")
    got = [r[0] for r in df.select(sessions.quality({k: F.col(k) for k in sessions.QUALITY})).collect()]
    assert got[0] == pytest.approx((0.3 + 0.1) / 0.5) and got[1] is None
    rows = [("a", i, i >= 4) for i in range(7)] + [("b", 0, True)] + [("c", i, None) for i in range(4)]
    out = {r["s"]: r for r in sessions.frustration(spark.createDataFrame(rows, "s string, i int, f boolean"), "s", ["i"], F.col("f")).collect()}
    assert out["a"]["abandoned"] and out["a"]["escalated"] and not out["b"]["abandoned"] and not out["c"]["escalated"]


def test_distillation(spark):
    said = {"a": ["alpha beta", "gamma", "alpha beta", "", "delta"], "b": ["only one"]}
    rows = [(s, i, "user" if i % 2 == 0 else "assistant", t) for s, ts in said.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "s string, no int, role string, t string")
    out = {(r["s"], r["no"]): r for r in sessions.semantic_signals(df, "s", "no", F.filter(F.split("t", " "), lambda x: x != "")).collect()}
    assert len(out) == len(rows)
    assert [round(out["a", i]["shift"], 6) for i in range(5)] == [0.5, 1.0, 1.0, 0.5, 1.0]
    assert [round(out["a", i]["unique"], 6) for i in range(5)] == [1.0, 1.0, 0.0, 1.0, 1.0] and out["b", 0]["unique"] == 1.0
    got = {(r["s"], r["no"]): (r["importance"], r["kept"]) for r in sessions.distil(df, "s", "no", {"position": F.when(F.col("no") == 2, 0.1).otherwise(0.5)}).collect()}
    assert got["b", 0] == (1.0, True) and got["a", 0] == (0.5, True) and got["a", 1] == (pytest.approx(0.3), True)
    assert got["a", 2] == (0.1, False) and got["a", 3][1] is False and got["a", 4][1] is True


def test_sessions_of_any_name_in_paths(spark, tmp_path):
    from parlance.plans.more import sessions_by_file

    spark.createDataFrame([("s00-1f",), ("other_7",), (None,), ("",), ("gone",)], "session_id string").write.parquet(f"{tmp_path}/prompts.parquet")
    spark.createDataFrame([("a", "/x/s00-1f.json"), ("a", "/x/other_7/s00-1f.json"), ("b", "/y/other_7"), ("b", "/y/none"), ("b", None)], "source string, file_path string").write.parquet(f"{tmp_path}/processed_sessions.parquet")
    assert {tuple(r) for r in sessions_by_file(spark, str(tmp_path)).collect()} == {("a", 2, 2), ("b", 1, 1)}


def test_secrets_of_all_kinds(spark, tmp_path):
    from parlance.plans.texts import secrets_by_source

    said = ["AKIA" + "A1B2" * 4, "password: hunter22 in /home/ana/", "mail ana@firm.test", "mail ana@firm.test", None]
    spark.createDataFrame([("a", t) for t in said], "source string, text string").write.parquet(f"{tmp_path}/prompts.parquet")
    assert {tuple(r) for r in secrets_by_source(spark, str(tmp_path)).collect()} == {("a", "api_key_aws", 1, 1), ("a", "password_assignment", 1, 1), ("a", "home_path_unix", 1, 1), ("a", "email", 2, 1)}


def test_recurring_topics(spark, tmp_path):
    """Edited repeats over sessions are one topic; groups within one session are none."""
    from parlance.plans.more import recurring_topics

    base = "please fix the parser crash when loading nested config files today"
    said = [("s1", base), ("s2", base.replace("today", "again")), ("s2", base.upper()), ("s3", "write release notes for version nine of billing"), ("s3", "write release notes for version nine of shipping"), (None, "how do monads work"), ("s4", "draw a chart"), (None, None), ("s5", " ")]
    said += [(f"s{i % 4}", " ".join(random.Random(i).choices("alpha beta gamma delta eps zeta".split(), k=5))) for i in range(30)]
    spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(said)], "id bigint, session_id string, text string").write.parquet(f"{tmp_path}/prompts.parquet")
    by = {}
    for i, (_, t) in enumerate(said):
        if t is not None:
            by.setdefault(" ".join(t.lower().split()) or " ", []).append(i)
    stems = [[w[:4] for w in t.split()] for t in by]
    count, n = [{w: x.count(w) for w in x} for x in stems], sum(1 for x in stems if x)
    raw = [{w: (1 + math.log(c)) * (math.log((1 + n) / (1 + sum(w in y for y in count))) + 1) for w, c in x.items()} for x in count]
    unit = [{w: v / math.sqrt(sum(y * y for y in x.values())) for w, v in x.items()} for x in raw]
    group = list(range(len(unit)))
    for i, x in enumerate(unit):
        for j, y in enumerate(unit[:i]):
            if x and y and 0.6 * sum(v * y.get(w, 0) for w, v in x.items()) + 0.4 * len(x.keys() & y.keys()) / min(len(x), len(y)) >= 0.75:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want, ids = set(), list(by.values())
    for g in set(group):
        texts = [ids[i] for i in range(len(ids)) if group[i] == g]
        rows = [i for t in texts for i in t]
        if (s := len({said[i][0] for i in rows})) >= 2:
            want.add((min(rows), s, len(texts), len(rows)))
    got = {tuple(r) for r in recurring_topics(spark, str(tmp_path)).collect()}
    assert got == want and (0, 2, 2, 3) in got


@pytest.mark.parametrize(("block", "terms"), [(256, 4096), (4, 3)])
def test_uniqueness_is_exact(spark, monkeypatch, block, terms):
    """Also below a cosine of a half, and over the bounds of blocks."""
    monkeypatch.setattr(sessions, "BLOCK", block)
    monkeypatch.setattr(sessions, "TERMS", terms)
    rng = random.Random(6)
    said = {s: [" ".join(rng.choices("abcdefghijklmnop", k=rng.choice([0, 1, 3, 6]))) for _ in range(n)] for s, n in (("x", 19), ("y", 2), ("z", 1))}
    df = spark.createDataFrame([(s, i, t) for s, ts in said.items() for i, t in enumerate(ts)], "s string, no int, t string").repartition(3)
    want, low = {}, 0
    for s, ts in said.items():
        count = [{w: t.split().count(w) for w in t.split()} for t in ts]
        n = sum(1 for c in count if c)
        raw = [{w: (1 + math.log(c)) * (math.log((1 + n) / (1 + sum(w in d for d in count))) + 1) for w, c in x.items()} for x in count]
        unit = [{w: v / math.sqrt(sum(y * y for y in x.values())) for w, v in x.items()} for x in raw]
        for i, x in enumerate(unit):
            best = max((sum(v * y.get(w, 0) for w, v in x.items()) for y in unit[:i]), default=0)
            low += 0 < best < 0.5
            want[s, i] = pytest.approx(1 - best, abs=1e-9)
    got = {(r["s"], r["no"]): r["unique"] for r in sessions.semantic_signals(df, "s", "no", F.filter(F.split("t", " "), lambda x: x != "")).collect()}
    assert got == want and low > 1


# Graphs and similarity ------------------------------------------------------------------------------------------------------------
def test_leaders_and_components(spark):
    rng = random.Random(4)
    links = {(rng.randrange(80), rng.randrange(80)) for _ in range(110)}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    leader = {}
    for x in sorted(near):
        mine = [y for y in sorted(near[x]) if y < x and leader[y] == y]
        leader[x] = mine[0] if mine else x
    df = spark.createDataFrame(sorted(links), "a int, b int")
    assert {r[0]: r[1] for r in graph.leaders(df).collect()} == leader
    assert graph.leaders(df.limit(0)).count() == 0
    part = {}
    for x in sorted(near):
        todo = [x] if x not in part else []
        while todo:
            y = todo.pop()
            if y not in part:
                part[y] = x
                todo += near[y]
    got = {r[0]: r[1] for r in graph.connected_components(df).collect()}
    assert {k: v for k, v in got.items() if k in part} == part


def test_cosine_pairs(spark):
    rng = random.Random(5)
    docs = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 12))) for _ in range(70)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, t string")
    w = tfidf.weights(tfidf.term_counts(df, "id", F.filter(F.split(F.coalesce("t", F.lit("")), " "), lambda x: x != "")), "id").collect()
    vec = {}
    for r in w:
        vec.setdefault(r["id"], {})[r["term"]] = r["w"]
    cos = lambda a, b: sum(x * vec[b].get(k, 0) for k, x in vec[a].items())
    want = {(a, b) for a in vec for b in vec if a < b and cos(a, b) >= 0.8}
    got = {(r["a"], r["b"]) for r in tfidf.cosine_pairs(spark.createDataFrame(w), "id", 0.8).collect()}
    assert got == want and want


def test_patterns(spark, monkeypatch):
    monkeypatch.setattr(patterns, "MAX_PATTERNS", 3)
    df = spark.createDataFrame([(1, "abcab"), (2, None), (3, "")], "id int, t string")
    pats = spark.createDataFrame([("ab",), ("bc",), ("zz",), ("",), (None,), ("ab",)], "p string")
    assert sorted(map(tuple, patterns.contained(df, "id", "t", pats, "p").collect())) == [(1, "ab"), (1, "bc")]
    assert patterns.contained(df, "id", "t", pats.limit(0), "p").count() == 0


# Text and periods -----------------------------------------------------------------------------------------------------------------
def test_text_functions(spark):
    def one(value, f):
        return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]

    lang = lambda c: text.language(text.script_counts(c))
    assert [one(x, lang) for x in ("hello", "你好世界", "これは日本語", "한국어 입니다", "```你好```", "")] == ["en", "zh", "ja", "ko", "en", "en"]
    assert [one(x, text.estimate_tokens) for x in ("", "one", "a b c d e f g h i j", "你好世界")] == [0, 1, 13, 6]
    assert [one(x, text.keep) for x in ("ok", "/compact now please", "git push origin main", "12345678901", "Explain this function", None)] == [False, False, False, False, True, False]
    assert one("  Fix it ", lambda c: F.transform(text.lint(c), lambda v: v["rule"])) == ["min-length", "vague-prompt"]
    assert one("mail a@b.io, x@example.com from 8.8.8.8 and 10.0.0.1 AKIA" + "A" * 16, lambda c: F.transform(text.secrets(c), lambda v: v["value"])) == ["AKIA" + "A" * 16, "a@b.io", "8.8.8.8"]
    assert one("Foo.bar 你好吗 x", text.mixed_tokens) == ["foo.bar", "你好", "好吗"]
    assert one("Running in a.b", text.stem4) == ["runn", "in", "a.b"]


def test_segments_and_scores(spark):
    parts = features.segment_text("You are a reviewer.\n\nFix app.py please\n\n```\ncode\n```\n\nzzz")
    assert [p[1] for p in parts] == ["system_role", "instruction", "context", "context"]
    assert features.segment_text("") == [] and features.segment_text(None) == []
    df = features.with_features(spark.createDataFrame([("Fix the TypeError in src/app.py line 12 and do not change tests",), ("",), (None,), ("word " * 20000,)], "text string"))
    rows = df.select("*", *[c.alias(k) for k, c in features.sub_scores().items()]).collect()
    assert rows[0]["has_errors"] and rows[0]["n_files"] == 2 and rows[0]["n_constraints"] == 1 and rows[0]["opening"] == pytest.approx(1.0)
    assert rows[1]["n_words"] == 0 and rows[1]["ambiguity"] == 1.0 and rows[3]["n_words"] == 20000
    assert all(0 <= r["total"] <= 100 for r in rows)


def test_compression():
    c = rewriting.compress_text
    assert c("Could you please  fix it in order to pass?") == "Fix it to pass?"
    assert c("Use `really very` and src/very/just.py, just now") == "Use `really very` and src/very/just.py, now"
    assert c("“Quoted” — text. Thanks a lot!") == '"Quoted" - text.'
    assert c("keep  the really long  form", safe=True) == "keep the really long form"
    assert c(None) is None and c("") == "" and c(" \n") == "" and len(c("word " * 50000)) > 100000
    long = "Some background about the log.\n\nMore lines here.\n\nMaybe fix the parser"
    assert rewriting.rewrite_text(long).startswith("fix the parser")


@given(st.text(alphabet="ab ,.`*\n-please just", max_size=60))
@settings(max_examples=300, deadline=None)
def test_compression_settles(t):
    once = rewriting.compress_text(t)
    assert rewriting.compress_text(once) == once


def test_build(spark):
    df = spark.createDataFrame([("do it", None, " "), ("x", "you are y", "z")], "task string, role string, error string")
    got = [r[0] for r in df.select(rewriting.build({c: F.col(c) for c in df.columns}, "xml")).collect()]
    assert got == ["<task>\ndo it\n</task>", "<role>\nyou are y\n</role>\n\n<task>\nx\n</task>\n\n<error>\nz\n</error>"]


def test_periods(spark):
    assert periods.parse_period("4w") == timedelta(days=28) and periods.parse_period("1m") == timedelta(days=30)
    with pytest.raises(ValueError):
        periods.parse_period("soon")
    end = datetime(2024, 2, 1)
    rows = [(datetime(2024, 1, 31, 23, 59, 59), 1.0), (datetime(2024, 2, 1), 9.0), (datetime(2024, 1, 18), 3.0), (None, 5.0)]
    s = periods.snapshots(spark.createDataFrame(rows, "at timestamp, v double"), "at", end, timedelta(days=7), 3, {"total": F.sum("v")})
    assert [(r["no"], r["n_rows"], r["total"]) for r in s.orderBy("no").collect()] == [(0, 0, None), (1, 1, 3.0), (2, 1, 1.0)]
    assert [r["pct"] for r in periods.deltas(s, "n_rows").orderBy("no").collect()] == [0.0, 0.0, 0.0]


def test_materialized_tables_are_released(spark):
    from parlance.session import materialize, release, shared_dir

    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file://"))
    assert release(spark) >= 1 and release(spark) == 0


def test_package_is_shipped(spark):
    import zipfile

    from parlance.session import ship

    assert "parlance/operators/shred.py" in zipfile.ZipFile(ship(spark)).namelist()


def test_pairs_over_blocks(spark, monkeypatch):
    """Candidates stay in the task of their block pair: the pairs are those of one block, and the plan sends none of them."""
    rng = random.Random(11)
    docs = [(i, rng.choices([c * 2 for c in "abcdefghijklmnopqrst"], k=rng.randint(1, 9))) for i in range(90)]
    v = tfidf.weights(tfidf.term_counts(spark.createDataFrame(docs, "id bigint, t array<string>"), "id", F.col("t")), "id").cache()
    got = lambda: {(r["a"], r["b"]): round(r["similarity"], 9) for f, x in ((tfidf.cosine_pairs, 0.5), (tfidf.blended_pairs, 0.6)) for r in f(v, "id", x).collect()}
    want = got()
    monkeypatch.setattr(tfidf, "BLOCK", 40)
    monkeypatch.setattr(tfidf, "AT_ONCE", 50)
    assert got() == want and want
    assert "Exchange" not in tfidf.cosine_pairs(v, "id", 0.5)._jdf.queryExecution().executedPlan().toString()
