"""Agent sessions, scores, Chinese features, templates, stores and file sinks on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import chinese, features, scoring, templates, text
from parlance.operators import agents, stores
from parlance.sources import files, readers

LINES = "rec_id bigint, session_id string, type string, timestamp string, message struct<role:string,content:string>, extra string"


def greedy(steps):
    """Loops by the plain greedy pass: pairs first, then runs among the steps that are left."""
    found, used, i = [], set(), 0
    while i < len(steps) - 3:
        a, b, j = steps[i], steps[i + 1], i + 2
        if a != b:
            while steps[j : j + 2] == [a, b]:
                j += 2
        if a != b and j - i >= 4:
            found.append((i, j - 1, (j - i) // 2, f"{a}->{b}"))
            used |= set(range(i, j))
            i = j
        else:
            i += 1
    i = 0
    while i < len(steps):
        j = i + 1
        while i not in used and j < len(steps) and steps[j] == steps[i] and j not in used:
            j += 1
        if i not in used and j - i >= 3:
            found.append((i, j - 1, j - i, steps[i]))
        i = j
    return sorted(found)


def test_loops(spark):
    rng = random.Random(3)
    said = {f"s{k}": [rng.choice("AB" if k % 2 else "ABC") for _ in range(rng.randint(0, 14))] for k in range(40)}
    rows = [(s, i, "assistant", [t], [None], False) for s, steps in said.items() for i, t in enumerate(steps)]
    df = spark.createDataFrame(rows, "session_id string, turn_no bigint, role string, tools array<string>, paths array<string>, failed boolean")
    got = {}
    for r in agents.loops(df).collect():
        got.setdefault(r["session_id"], []).append((r["start_turn"], r["end_turn"], r["loops"], r["fingerprint"]))
    assert {s: sorted(v) for s, v in got.items()} == {s: g for s, steps in said.items() if (g := greedy(steps))}
    e = {r["session_id"]: r for r in agents.efficiency(df, agents.loops(df)).collect()}
    assert all(e[s]["in_loops"] == sum(b - a + 1 for a, b, _, _ in greedy(v)) and e[s]["n_loops"] == len(greedy(v)) for s, v in said.items() if v)


def test_turns_and_signals(spark):
    use = lambda name, path=None: {"type": "tool_use", "name": name, "input": {"file_path": path} if path else {}}
    said = [
        ("user", "hello"), ("assistant", [{"type": "text", "text": "Error: no such file"}, use("Read", "a/b.py"), use("Bash")]), ("user", "ok"), ("assistant", "done"), ("user", "Why does it fail?"), ("assistant", "[broken"), ("user", "thanks"),
    ]
    rows = [(i, "s", role, None, (role, c if isinstance(c, str) else json.dumps(c)), "x") for i, (role, c) in enumerate(said)] + [(90, None, "user", None, ("user", "lost"), "x"), (91, "t", "user", None, None, "x"), (92, "u", "user", None, ("user", None), "x")]
    t = agents.turns_of_lines(spark.createDataFrame(rows, LINES))
    s = [r for r in t.orderBy("session_id", "turn_no").collect() if r["session_id"] == "s"]
    assert s[1]["tools"] == ["Read", "Bash"] and s[1]["failed"] and s[5]["text"] == "[broken" and not s[5]["failed"]
    f = t.select(agents.fingerprint(F.col("tools"), F.col("paths"), F.col("failed")).alias("f")).filter("f IS NOT NULL").collect()
    assert [r["f"] for r in f] == ["Read(b.py):err→Bash:err"]
    g = {r["turn_no"]: r for r in agents.signals(t).collect() if r["session_id"] == "s"}
    # A greeting first and a closing last count nothing; "ok" after an error is no recovery.
    assert [g[i]["position"] for i in (0, 2, 4, 6)] == pytest.approx([0.0, 0.3 + 0.2 / 3, 0.3 + 0.4 / 3, 0.0]) and g[0]["tool"] == pytest.approx(0.4) and g[2]["error"] == 0.0
    k = {r["session_id"]: r["kind"] for r in agents.distilled(t).select("session_id", "kind").distinct().collect()}
    assert k == {"s": "debugging", "u": None}
    status = {r[0]: r[1] for r in agents.final_status(t).collect()}
    assert status == {"s": "error", "u": "success"}
    e = agents.export(agents.distilled(t)).filter("session_id = 's'").first()
    assert e["goal"] == "hello" and e["n_turns"] == 7 and agents.turns_of_lines(spark.createDataFrame([], LINES)).count() == 0


def test_effectiveness(spark):
    rows = [("success", 900, 10, 1, 0.85), ("error", 8000, 0, 0, 0.15), ("unknown", None, 4, 4, 0.35)]
    df = spark.createDataFrame(rows, "status string, seconds bigint, calls bigint, errors bigint, want double")
    got = df.select(agents.effectiveness(*[F.col(c) for c in ("status", "seconds", "calls", "errors")]).alias("e"), agents.stars(F.col("want")).alias("s")).collect()
    assert [r["e"] for r in got] == pytest.approx([0.85, 0.15, 0.35]) and got[0]["s"] == "★★★★☆"


PROMPTS = [
    "Fix the TypeError in auth/login.py line 40: input: None output: error. Do not change tests. What happens when the token is empty? Return as JSON.",
    "fix it", "", None, "Explain how the retry loop works, step by step, and I think you should keep it short.",
]


def test_scores(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PROMPTS)], "id bigint, text string, total string").drop("total")
    f = features.with_features(df.withColumn("task", text.category(F.coalesce("text", F.lit("")))))
    s = {r["id"]: r for r in scoring.scored(f, "task").collect()}
    assert s[0]["total"] > s[4]["total"] > s[1]["total"] and s[0]["tier"] in ("GOOD", "STRONG") and s[2]["total"] == s[3]["total"]
    assert {x["category"] for x in s[1]["suggestions"]} >= {"structure", "context", "clarity"} and any(c["category"] == "context" for c in s[0]["confirmations"])
    assert s[0]["has_edge_cases"] and s[0]["n_examples"] == 1
    m = {r["id"]: r["total"] for r in scoring.scored(f, "task", model="gpt").collect()}
    assert m[4] == pytest.approx(s[4]["total"] - 3, abs=0.11) and m[1] == s[1]["total"]
    e = scoring.scored(f, "task").select("id", *[c.alias(k) for k, c in scoring.explain(F.col("task"), F.lit(0.0)).items()]).collect()
    assert "Very short" in {r["id"]: r for r in e}[1]["weaknesses"]


def test_check(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PROMPTS[:2] + [None])], "id bigint, text string")
    c = {r["id"]: r for r in scoring.check(df, "text", threshold=43).collect()}
    assert c[0]["passed"] and c[0]["missing"] == [] and not c[1]["passed"] and c[1]["missing"][:3] == ["code", "files", "error"]
    assert {x["rule"] for x in c[1]["lint"]} == {"min-length", "vague-prompt"} and c[1]["grade"] in ("D", "F")
    w = scoring.compare(spark.createDataFrame([(PROMPTS[0], PROMPTS[1]), ("same", "same")], "a string, b string"), "a", "b").collect()
    assert [r["winner"] for r in w] == ["a", "a"]


def test_chinese(spark):
    rows = ["修复 src/app.py 第40行的错误，必须保证不要改动测试。例如：输入：空 输出：报错。", "看看这个东西，可能大概好像有点不对，随便改改吧", "```x```", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id bigint, text string")
    f = {r["id"]: r for r in chinese.with_features(df).collect()}
    assert f[0]["has_files"] and f[0]["has_errors"] and f[0]["n_constraints"] == 3 and f[0]["has_examples"] and f[0]["n_files"] == 2 and f[0]["opening"] == pytest.approx(1.0)
    assert f[1]["ambiguity"] > 0.25 and f[4]["n_words"] == 0 and f[4]["ambiguity"] == 1.0
    r = {x["id"]: x["locale"] for x in chinese.routed(df).collect()}
    assert r[0] == "zh" and r[2] == "en" and len(r) == 5


def test_templates(spark):
    df = spark.createDataFrame([(1, "Fix {file} in {file} for {who}", "a.py"), (2, "fix FILE in file", None), (3, "!!", None)], "id bigint, t string, f string")
    got = df.select(templates.variables(F.col("t")).alias("v"), templates.render(F.col("t"), {"file": F.col("f")}).alias("r")).collect()
    assert got[0]["v"] == ["file", "who"] and got[0]["r"] == "Fix a.py in a.py for {who}" and got[1]["r"] == "fix FILE in file"
    assert {r["id"]: r["name"] for r in templates.named(df, "t", ["id"]).collect()} == {1: "fix-file-in-file", 2: "fix-file-in-file-2", 3: "template"}
    u = templates.used(spark.createDataFrame([("a", 2), ("b", None)], "k string, n_used bigint"), spark.createDataFrame([("a",), ("a",)], "k string"), "k")
    assert {r["k"]: r["n_used"] for r in u.collect()} == {"a": 4, "b": 0}


def test_updates(spark, tmp_path):
    s = spark.createDataFrame([(1, "a", 0.1), (2, None, 0.2), (3, "b", None)], "id bigint, k string, v double")
    out = {r["id"]: r["v"] for r in stores.update(s, spark.createDataFrame([("a", 0.5), ("z", 1.0), (None, 9.0)], "k string, v double"), ["k"], ["v"]).collect()}
    assert out == {1: 0.5, 2: 0.2, 3: None}
    p = f"file://{tmp_path}/t"
    s.write.parquet(p)
    assert stores.truncate(spark, p) == 3 and spark.read.parquet(p).count() == 0
    kv = stores.settings(spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string"), {"y": "3", "z": "4"})
    assert {r["key"]: r["value"] for r in kv.collect()} == {"x": "1", "y": "3", "z": "4"}
    names = spark.createDataFrame([("ab",), ("abc",), ("x",), (None,)], "n string")
    assert [r["n"] for r in stores.by_prefix(names, "n", "ab").collect()] == ["ab"] and sorted(r["n"] for r in stores.by_prefix(names, "n", "a").collect()) == ["ab", "abc"]


def test_files(spark, tmp_path):
    rows = [(f"file://{tmp_path}/d/{k % 3}.txt", i, f"line {i}" if i else None) for k in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, i bigint, line string").repartition(4)
    assert sorted((r["path"][-5:], r["n"]) for r in files.write_lines(df, "path", "line", ["i"]).collect()) == [("0.txt", 4), ("1.txt", 4), ("2.txt", 4)]
    assert (tmp_path / "d" / "1.txt").read_text().split("\n") == [f"line {i}" for i in range(1, 5)] + [""]
    items = spark.createDataFrame([(f"file://{tmp_path}/session-1.json", 1, '{"id": "m", "type": "user", "content": "hello you", "timestamp": null}')], "path string, i bigint, item string")
    files.write_lines(files.array_lines(items, "path", "item", ["i"], "concat('{\"sessionId\": \"s1\", \"messages\": [')", "]}"), "path", "line", ["part", "_k"]).count()
    assert [(r["session_id"], r["text"]) for r in readers.gemini(spark, f"file://{tmp_path}").collect()] == [("s1", "hello you")]


def test_settings(tmp_path):
    from parlance import config

    f = tmp_path / "c.toml"
    f.write_text("[tool.x]\nleast = 5\nshort = 9\nunknown = 1\n")
    c = config.load(config.LintConfig, str(f), "tool.x", env={"PARLANCE_SHORT": "7"}, model="gpt")
    assert (c.least, c.short, c.max_tokens, c.model) == (5, 7, 0, "gpt") and config.load(config.Settings, env={}).embedder == "tfidf"
    for bad in ({"nothing": 1}, {"least": "x"}):
        with pytest.raises(ValueError):
            config.load(config.LintConfig, env={}, **bad)
    assert config.default_path("cursor", "/h/", "darwin").startswith("/h/Library") and config.default_path("codex", "/h") == "/h/.codex/sessions"


def test_embedders(spark):
    from parlance.operators import embedders

    df = spark.createDataFrame([(1, "red apple"), (2, "red apple"), (3, None), (4, " ")], "id bigint, t string")
    v = {r["id"]: r["vector"] for r in embedders.embed(df, "id", "t").collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1.0) and not any(v[3]) and len(v[4]) == embedders.BUCKETS
    embedders.EMBEDDERS["length"] = embedders.batched(lambda texts: [[len(t), 1.0] for t in texts])
    assert {r["id"]: r["vector"] for r in embedders.embed(df, "id", "t", "length").collect()} == {1: [9.0, 1.0], 2: [9.0, 1.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}
    with pytest.raises(ValueError):
        embedders.embed(df, "id", "t", "none")


def test_names(spark):
    df = spark.createDataFrame([("/usr/bin python",), ("2024 2025",), ("git sudo",), ("retry loop",), ("",)], "t string")
    assert [r[0] for r in df.select(text.noise_term(F.col("t"))).collect()] == [True, True, True, False, True]
    one = spark.createDataFrame([("Fix the login in src/a.py for user_id 7 now please",)], "t string").select(text.cluster_name(F.col("t")).alias("n"), text.canonical_score(F.lit(50), F.lit(100), F.col("t"), F.lit(None).cast("double")).alias("s")).first()
    assert one["n"] == "Fix the login in src/a.py for…" and one["s"] == pytest.approx(0.25 + 0.3 + 0.1)


def test_distillation_joins_nothing(spark, monkeypatch):
    """Turns are sent by session twice, tables of any size join or broadcast nothing, and long sessions have the results of short ones."""
    from parlance.operators import sessions

    rng = random.Random(8)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    rows = [(k * 100 + i, f"s{k}", "assistant" if i % 3 == 1 else "user", f"2025-01-01T00:00:{i:02d}Z", (None, " ".join(rng.choices(words, k=rng.choice([0, 2, 5])))), None) for k, n in enumerate((1, 5, 30, 44)) for i in range(n)]
    t = agents.turns_of_lines(spark.createDataFrame(rows, LINES))
    d = agents.distilled(t)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") <= 2
    got = lambda: {(r["session_id"], r["turn_no"]): (round(r["importance"], 9), r["kept"], r["kind"]) for r in agents.distilled(t).collect()}
    want = got()
    monkeypatch.setattr(sessions, "FEW", 2)
    assert got() == want
    monkeypatch.setattr(sessions, "BLOCK", 8)
    assert got() == want and len(want) == len(rows)


def test_steps_in_loops(spark):
    """Rows of loops are known without a join, whatever the rows without a step between them."""
    from parlance.operators import sessions

    rng = random.Random(6)
    said = {f"s{k}": [rng.choice(("AB", "ABC", "AABC")[k % 3]) for _ in range(rng.randint(0, 24))] for k in range(150)}
    rows = [(s, 2 * i + j, x) for s, steps in said.items() for i, t in enumerate(steps) for j, x in enumerate((t, None))]
    d = sessions.in_loops(spark.createDataFrame(rows, "s string, no bigint, step string").repartition(3), "s", ["no"], "step")
    got = {f: {(r["s"], r["no"] // 2) for r in d.filter(f).collect() if r["step"]} for f in ("in_loop", "begins", "ends")}
    found = [(s, *g[:2]) for s, v in said.items() for g in greedy(v)]
    assert got["in_loop"] == {(s, i) for s, a, b in found for i in range(a, b + 1)} and len(found) > 100
    assert got["begins"] == {(s, a) for s, a, _ in found} and got["ends"] == {(s, b) for s, _, b in found} and d.filter("step IS NULL AND (in_loop OR begins OR ends)").isEmpty()


@pytest.fixture(scope="module")
def logged(spark, tmp_path_factory):
    """A folder with a claude_session of sessions with loops, errors, stalls and users alone."""
    rng = random.Random(5)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    rows = []
    for k in range(60):
        for i in range(rng.randint(1, 24)):
            text = " ".join(rng.choices(words, k=rng.choice([0, 2, 5, 12])))
            role, content = "user", text
            if k % 10 and rng.random() < 0.75:
                used = [{"type": "tool_use", "name": rng.choice("ABC"[: 1 + k % 3]), "input": {"file_path": "x/y.py"} if k % 2 else {}}] * rng.choice([0, 1, 1, 1, 1, 2])
                role, content = "assistant", json.dumps([{"type": "text", "text": text + " Error" * (rng.random() < k / 120)}, *used])
            rows.append((len(rows), f"s{k}", role, f"2025-01-01T{i % 24:02d}:{rng.randint(0, 59):02d}:00Z" if k % 4 else "2025-01-01T00:00:00Z", (role, content), None))
    d = tmp_path_factory.mktemp("logged")
    spark.createDataFrame(rows, LINES).write.parquet(f"file://{d}/claude_session.parquet")
    return f"file://{d}"


def joins_nothing(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_quality_joins_nothing(spark, logged, monkeypatch):
    """One aggregation gives what the parts give each, and no part is broadcast or sent again."""
    from parlance.operators import sessions
    from parlance.plans import agents as plans

    assert joins_nothing(plans.agent_quality(spark, logged))
    t = plans._turns(spark, logged)
    by = lambda df: {r["session_id"]: r.asDict() for r in df.collect()}
    parts = [by(x) for x in (agents.efficiency(t, agents.loops(t)), plans.session_effectiveness(spark, logged), agents.distilled(t).groupBy("session_id").agg(F.avg(F.col("kept").cast("double")).alias("focus")), agents.frustration(t))]
    want = {s: {"abandoned": False, "escalated": False, "stalls": 0} | {k: v for p in parts for k, v in p.get(s, {}).items()} for s in parts[0]}
    seen = by(agents.summaries(plans._seconds(t)))
    assert seen == {s: {k: want[s][k] for k in r} for s, r in seen.items()}
    assert set(seen) == set(want) == {f"s{k}" for k in range(60)} and {r["productive"] < 1 for r in seen.values()} == {r["escalated"] for r in seen.values()} == {r["abandoned"] for r in seen.values()} == {True, False}
    quality = by(plans.agent_quality(spark, logged))
    monkeypatch.setattr(sessions, "BLOCK", 8)
    assert by(plans.agent_quality(spark, logged)) == quality and len(quality) == 60


def test_exports_join_nothing(spark, logged):
    """What a next session must know is gathered where the distilled turns lie, and is what a plain pass over them gives."""
    from parlance.plans import agents as plans

    assert joins_nothing(plans.session_exports(spark, logged))
    t = plans._turns(spark, logged).withColumn("text", F.when(F.col("turn_no") % 5 == 0, F.concat("text", F.lit(" Then next"))).otherwise(F.col("text")))
    d = agents.distilled(t, columns=["text", "paths"]).withColumn("tool", F.when(F.col("turn_no") % 3 == 0, 2.0).otherwise(F.col("tool")))
    said = {}
    for r in sorted(d.collect(), key=lambda r: (r["session_id"], r["turn_no"])):
        said.setdefault(r["session_id"], []).append(r)
    got = {r["session_id"]: r.asDict() for r in agents.export(d).collect()}
    for s, rows in said.items():
        users, kept = [r for r in rows if r["role"] == "user"], [r for r in rows if r["kept"]]
        top = sorted(sorted((r for r in users if r["kept"]), key=lambda r: (-r["importance"], r["turn_no"]))[:5], key=lambda r: r["turn_no"])
        decided = lambda r: (r["shift"] or 0) >= (r["tool"] or 0)
        ahead = [r["text"] for r in users[-3:] if "next" in r["text"]]
        files = {f for r in rows for f in r["paths"]}
        assert got[s] == {
            "session_id": s, "goal": users[0]["text"] if users else None, "decisions": [r["text"][:120] for r in top if decided(r)], "actions": [r["text"][:120] for r in top if not decided(r)],
            "resume": ahead[-1] if ahead else None, "files": sorted(files - {None}) + [None] * (None in files), "n_turns": len(rows), "n_kept": len(kept), "n_tokens": sum(len(r["text"]) for r in kept) // 4 if kept else None,
        }
    assert len(got) == len(said) == 60 and any(g["resume"] for g in got.values()) and any(g["actions"] for g in got.values()) and any(g["decisions"] for g in got.values())


def test_exports_send_little(spark, logged):
    """Texts of assistants are not sent, and of long texts of users the rows are those of whole distilled turns."""
    from parlance.plans import agents as plans

    lines = spark.read.parquet(f"{logged}/claude_session.parquet")
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat_ws(" ", "rec_id", i.cast("string")), 256)), " ")
    said = F.when(F.col("type") == "assistant", F.concat_ws(" ", noise, F.lit("error"))).otherwise(F.concat_ws(" then ", F.repeat(F.col("message.content"), 9), F.when(F.col("rec_id") % 4 > 0, "end")))
    said = F.when(F.col("rec_id") % 13 > 0, said)
    d = f"{logged}/long"
    lines.withColumn("message", F.struct(F.col("message.role").alias("role"), F.when(F.col("rec_id") % 3 == 0, said).otherwise(F.col("message.content")).alias("content"))).write.parquet(f"{d}/claude_session.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))
    before = sent()
    got = sorted(plans.session_exports(spark, d).collect())
    assert sent() - before < 500_000 < lines.filter("type = 'assistant' AND rec_id % 3 = 0").count() * 10_000
    want = sorted(agents.export(agents.distilled(plans._turns(spark, d))).collect())
    assert got == want and len(got) == 60 and max(len(r["goal"] or "") for r in got) > 120 and max(len(r["resume"] or "") for r in got) > 120
