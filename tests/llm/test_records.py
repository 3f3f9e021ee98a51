"""Conversations, personal information, vectors and containers on hostile small inputs."""

import random
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import components, conversations, neighbours, packing, pii

# Conversations ------------------------------------------------------------------------------------------------------------------
MAPPING = "rec_id bigint, conversation_id string, extra int, mapping map<string,struct<id:string,parent:string,children:array<string>,message:struct<id:string,author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<string>>>>>"


def node(key, parent, children, role=None, parts=None):
    message = None if role is None else {"id": key, "author": {"role": role}, "create_time": None, "content": {"content_type": "text", "parts": parts}}
    return {"id": key, "parent": parent, "children": children, "message": message}


def chat(*turns, tail=()):
    keys = ["r"] + [f"k{i}" for i in range(len(turns))]
    out = {"r": node("r", None, ["k0"])}
    for i, (role, text) in enumerate(turns):
        out[f"k{i}"] = node(f"k{i}", keys[i], list(tail) if i == len(turns) - 1 else [f"k{i + 1}"], role, text if isinstance(text, list) else [text])
    return out


def test_mappings(spark):
    good = chat(("user ", "q"), ("Assistant", "a"))
    rows = [
        (1, "good", 0, good),
        (2, "good", 0, good),
        (3, "unanswered", 0, chat(("user", "q"), ("assistant", "a"), ("user", "again"))),
        (4, "late", 0, chat(("assistant", "a"), ("user", "q"), ("assistant", "b"))),
        (5, "cycle", 0, chat(("user", "q"), ("assistant", "a"), tail=["k0"])),
        (6, "badchild", 0, chat(("user", "q"), ("assistant", "a"), tail=["gone"])),
        (7, "tworoots", 0, {**good, "s": node("s", None, [])}),
        (8, "null", 0, None),
        (9, "empty", 0, {}),
        (10, "blank", 0, chat(("user", "q"), ("system", "s"), ("assistant", " "), ("assistant", '{"content_type": "image"}'), ("assistant", ["", "a"]))),
        (11, "branch", 0, {**chat(("user", "q"), tail=["old", "new"]), "old": node("old", "k0", [], "assistant", ["x"]), "new": node("new", "k0", [], "assistant", ["y"])}),
        (12, None, 0, {"z1": node("z1", None, ["z2"], "human", ["q"]), "z2": node("z2", "z1", [], "assistant", ["a"])}),
    ]
    got = {tuple(r) for r in conversations.from_mappings(spark.createDataFrame(rows, MAPPING)).collect()}
    want = {
        ("good", 0, "k0", "user"), ("good", 1, "k1", "assistant"), ("blank", 0, "k0", "user"), ("blank", 1, "k4", "assistant"),
        ("branch", 0, "k0", "user"), ("branch", 1, "new", "assistant"), ("z1", 0, "z1", "user"), ("z1", 1, "z2", "assistant"),
    }
    assert got == want
    assert conversations.from_mappings(spark.createDataFrame([], MAPPING)).count() == 0


ARRAYS = "rec_id bigint, uuid string, chat_messages array<struct<uuid:string,sender:string,text:string,content:array<struct<type:string,text:string>>,index:int>>"


def test_message_arrays(spark):
    m = lambda u, s, i, t="hi", c=None: {"uuid": u, "sender": s, "text": t, "content": c, "index": i}
    pair = [m("b", "Assistant", 1), m("a", " human", 0)]
    rows = [
        (1, "good", pair[:1]),
        (2, "good", [*pair, pair[0]]),
        (3, "gap", [m("a", "human", 0), m("b", "assistant", 2)]),
        (4, "who", [m("a", "human", 0), m("b", "", 1)]),
        (5, "null", None),
        (6, "empty", []),
        (7, "content", [m("a", "human", 0, None, [{"type": "text", "text": "x"}]), m("b", "assistant", 1, "", [{"type": "thinking", "text": "y"}]), m("c", "assistant", 2)]),
    ]
    got = {tuple(r) for r in conversations.from_message_arrays(spark.createDataFrame(rows, ARRAYS)).collect()}
    assert got == {("good", 0, "a", "user"), ("good", 1, "b", "assistant"), ("content", 0, "a", "user"), ("content", 1, "c", "assistant")}


LINES = "rec_id bigint, session_id string, file_path string, uuid string, type string, timestamp string, message struct<role:string,content:string>, at string"


def test_lines(spark):
    t = lambda s: datetime.fromtimestamp(s, timezone.utc).isoformat()
    rows, rec = [], iter(range(10**6))
    add = lambda s, u, kind, at, content, role="same", f=None: rows.append((next(rec), s, f, u, kind, at, None if role is None else (kind if role == "same" else role, content), "x"))
    add("s1", "b", "assistant", t(20), '[{"type": "text", "text": "yes"}]')
    add("s1", "a", "user", t(10), "hello")
    add("s1", "a", "user", t(10), "hello")
    add("s1", "c", "summary", None, None, None)
    add("bad", "d", "user", t(1), "x")
    add("bad", "e", "assistant", "unknown", "y")
    add("norole", "f", "user", t(1), "x")
    add("norole", "g", "assistant", t(2), "y", " ")
    add(None, "h", "user", t(1), "x", f="/f1")
    add(" ", "i", "assistant", t(2), '[{"type": "tool_use", "text": "n"}, {"type": "text", "text": "y"}]', f="/f1")
    for i in range(400):
        add("long", f"l{i:04}", "user" if i % 2 == 0 else "assistant", t(1000 + i), "turn")
    df = spark.createDataFrame(rows, LINES).repartition(5)
    got = {tuple(r) for r in conversations.from_lines(df).collect()}
    want = {("s1", 0, "a", "user"), ("s1", 1, "b", "assistant"), ("/f1", 0, "h", "user"), ("/f1", 1, "i", "assistant")}
    want |= {("long", i, f"l{i:04}", "user" if i % 2 == 0 else "assistant") for i in range(400)}
    assert got == want
    assert conversations.from_lines(df.limit(0)).count() == 0


def test_lost_lines_join_identified_ones(spark):
    """A line without session goes to the session of its file, or of the line it quotes."""
    t = lambda i: f"2025-01-01T00:00:{i:02}Z"
    said = [
        ("s9", "/f9", "a1", "user", t(1), "hello"), (None, "/f9", "a2", "assistant", t(2), "yes"), (None, "/f9", "a3", "user", t(3), "more"), ("s9", "/f9", "a4", "assistant", t(4), "done"),
        ("s8", "/f8", "q1", "user", t(1), " What is a monad?\n"), ("", None, "q2", "assistant", t(2), "> What is a monad?\nA burrito."),
        ("s7", "/f7", "b1", "user", t(1), "left"), ("s6", "/f6", "c1", "user", t(1), "a"), ("s6", "/f6", "c2", "assistant", t(2), "b"), (None, "/f5", "d1", "user", t(1), "x"), (None, "/f5", "d2", "assistant", t(2), "y"),
    ]
    rows = [(i, s, f, u, kind, at, (kind, content), "x") for i, (s, f, u, kind, at, content) in enumerate(said)]
    got = {tuple(r) for r in conversations.from_lines(spark.createDataFrame(rows, LINES).repartition(3)).collect()}
    want = {("s9", i, f"a{i + 1}", "user" if i % 2 == 0 else "assistant") for i in range(4)}
    want |= {("s8", 0, "q1", "user"), ("s8", 1, "q2", "assistant"), ("s6", 0, "c1", "user"), ("s6", 1, "c2", "assistant"), ("/f5", 0, "d1", "user"), ("/f5", 1, "d2", "assistant")}
    assert got == want
    # An identified message that replies to an open one names it, too.
    df = spark.createDataFrame([("c1", "m1", "m2", "x"), (None, "m2", None, "y")], "conv_key string, msg_key string, reply_to string, text string")
    assert {r["msg_key"]: r["conv_key"] for r in conversations.identify(df).collect()} == {"m1": "c1", "m2": "c1"}


def test_quote_links(spark):
    rows = [("c1", "m1", None, "What is a monad?"), (None, "m2", None, "> What is a monad?\nA burrito."), ("", "m3", "m2", "Thanks."), (None, "m4", None, "alone"), (None, "m5", "m4", "reply")]
    df = spark.createDataFrame(rows, "conv_key string, msg_key string, reply_to string, text string")
    got = {r["msg_key"]: r["conv_key"] for r in conversations.identify(df).collect()}
    assert got == {"m1": "c1", "m2": "c1", "m3": "c1", "m4": "m4", "m5": "m4"}


def test_ambiguous_quotes(spark):
    """A short text that several messages have links nothing; a lost message between two conversations belongs to neither."""
    rows = [
        ("c1", "m1", None, "ok"), ("c2", "m2", None, "ok"), (None, "m3", None, "> ok\nfine"), (None, "m4", None, "> ok\nnext"), (None, "m5", None, "> nobody said this\nx"), (None, "m6", None, "> nobody said this\ny"),
        ("c3", "m7", "f", "a"), ("c4", "m8", "f", "b"), (None, "m9", "f", "c"),
    ]
    df = spark.createDataFrame(rows, "conv_key string, msg_key string, reply_to string, text string")
    got = {r["msg_key"]: r["conv_key"] for r in conversations.identify(df).collect()}
    assert got == {"m1": "c1", "m2": "c2", "m3": "m3", "m4": "m4", "m5": "m5", "m6": "m6", "m7": "c3", "m8": "c4", "m9": None}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(200)] + [(5000 + i, 5001 + i) for i in range(60)] + [(None, 3), (9999, 9999)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Personal information -------------------------------------------------------------------------------------------------------------
FOUND = [
    ("write to ana.b+x@mail.firm.test now", "email", "ana.b+x@mail.firm.test"),
    ("write to ana (at) firm (dot) test now", "email", "ana (at) firm (dot) test"),
    ("write to ana at firm dot test now", "email", "ana at firm dot test"),
    ("write to ana[at]mail[dot]firm[dot]example", "email", "ana[at]mail[dot]firm[dot]example"),
    ("mail аna@firm.test", "email", "аna@firm.test"),
    ("call +49 30 23125 457 today", "phone", "+49 30 23125 457"),
    ("call (206) 555-0174 today", "phone", "(206) 555-0174"),
    ("call 030/23125316, please", "phone", "030/23125316"),
    ("phone: 3125550179", "phone", "3125550179"),
    ("phone: +1 415 555 0134 2086 seconds", "phone", "+1 415 555 0134"),
    ("phone: ＋49 30 23125 457", "phone", "＋49 30 23125 457"),
    ("phone: two zero six, five five five, zero one seven four", "phone", "two zero six, five five five, zero one seven four"),
    ("the form rejects 939 63 2471 as national id", "idnum", "939 63 2471"),
    ("tax id QQ 62 93 96 D, real", "idnum", "QQ 62 93 96 D"),
    ("card 4111 1111 1111 1111 ok", "idnum", "4111 1111 1111 1111"),
    ("Ship it to 2053 Millrace Ave, Apt 23C,\nOakhollow, WA 69976 today", "address", "2053 Millrace Ave, Apt 23C,\nOakhollow, WA 69976"),
    ("to 22 Windle Road, Marrowby QZ2 5ZX now", "address", "22 Windle Road, Marrowby QZ2 5ZX"),
    ("to Harrowgatestraße 152, 61712 Fennwick today", "address", "Harrowgatestraße 152, 61712 Fennwick"),
    ("to Calle Tannery 65,\n26502 Nordhafen. Lo", "address", "Calle Tannery 65,\n26502 Nordhafen"),
    ("thanks to Nerys O'Dravin for the trace", "name", "Nerys O'Dravin"),
    ("Regards, Farouz J. Mowbrick\n", "name", "Farouz J. Mowbrick"),
    ("Eskeland, Anouska wrote this module", "name", "Eskeland, Anouska"),
    ("customer Quenby MOWBRICK complained", "name", "Quenby MOWBRICK"),
]
CLEAN = [
    "admin@example.com and x@mail.example.org", "clone git@code.firm.test:core/app.git first", "pin @types/kit@20.1.4 please", "order 9011-0186-9596-4901 was refunded",
    "build 312.555.0178 is broken", "part no. 912-44-88397 is missing", "version 20.79.46094", "job id 8814203346 hung", "trace 9615-9831-3488-9623 is cut off", "range 2025-01-28 to 2025-02-28",
    "Use Rose Pine theme", "Will Field validation run before save?", "the Quellmar Toolkit crashed", "12 Main Thread dumps attached", "38 Column Lane layout looks off", "look at core.py at once", "listen on 0.0.0.0:5550173", "checksum 8111 0000 68", "", " \n",
]


@pytest.mark.parametrize(("text", "kind", "val"), FOUND)
def test_items_found(text, kind, val):
    assert [(k, text[s:e]) for s, e, k in pii.find(text)] == [(kind, val)]
    assert pii.redact_text(text) == text.replace(val, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", CLEAN)
def test_nothing_found(text):
    names = pii.Names([("Rose", "given"), ("Will", "given"), ("Quellmar", "family"), ("Field", "family")])
    assert pii.find(text, names) == [] and pii.redact_text(text, names) == text


@given(st.text(alphabet="ab @.()[]dot+0123456789 АВ｀５\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_spans_are_in_the_source(text):
    last = 0
    for s, e, _ in pii.find(text):
        assert last <= s < e <= len(text)
        last = e
    a = pii.normalise(text)
    assert [a.span(i, i + 1)[0] for i in range(len(a.text))] == sorted(a.span(i, i + 1)[0] for i in range(len(a.text)))


def test_item_tables(spark):
    long = "word " * 50000 + "mail ana@firm.test " * 2
    df = spark.createDataFrame([(1, long, "v"), (2, None, "v"), (3, "", "v")], "id bigint, text string, val string")
    assert [tuple(r) for r in pii.items(df, ["id"]).collect()] == [(1, "email", "ana@firm.test")]
    out = {r["id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[1].endswith("mail [EMAIL] mail [EMAIL] ") and out[2] is None and out[3] == ""
    assert pii.items(df.limit(0), ["id"]).count() == 0


# Vectors --------------------------------------------------------------------------------------------------------------------------
def test_hilbert_is_a_curve():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_similar_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 24))
    base[600:] = base[:300] + rng.normal(size=(300, 24)) * 0.12
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0] * 23), (5004, [1.0, None] * 12), (5005, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id bigint, v array<double>, a string").repartition(4)
    x = base / np.linalg.norm(base, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(900) for j in np.argsort(-sim[i])[:5] if sim[i, j] >= 0.9}
    got = {tuple(r) for r in neighbours.similar_pairs(df, "id", "v", 24, 5, 0.9).collect()}
    assert len(want) > 200 and got <= want and len(got) >= 0.9 * len(want)
    assert neighbours.similar_pairs(df.limit(0), "id", "v", 24, 5, 0.9).count() == 0
    copies = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)], "id bigint, v array<double>")
    found = neighbours.nearest(copies, "id", "v", 4, 5, 0.99).groupBy("id").count().collect()
    assert len(found) == 3000 and all(r["count"] <= 5 for r in found)


# Containers -------------------------------------------------------------------------------------------------------------------------
def test_containers(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([1, 5, 90, 400, 700, 1300, 2048, 2049, 5000])) for i in range(1500)] + [(9000, 0), (9001, None)]
    out = packing.pack(spark.createDataFrame([(i, s, s) for i, s in sizes], "doc_id bigint, tokens bigint, size bigint"), "doc_id", "tokens").collect()
    load, pieces = {}, {}
    for r in out:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["tokens"]))
    total = sum(s for _, s in sizes if s)
    assert max(load.values()) <= 2048 and total / 2048 / len(load) > 0.985
    for i, s in sizes:
        got = sorted(pieces.get(i, []))
        assert sum(t for _, t in got) == (s or 0) and len(got) == -(-(s or 0) // 2048) and [n for n, _ in got] == list(range(len(got)))
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), "doc_id", "tokens").count() == 0


def test_crossover_keeps_every_item():
    island = packing.Island([random.Random(i).randint(1, 900) for i in range(120)], 1000, 4)
    a, b = island.first(False), island.first(True)
    for child in (island.cross(a, b), island.mutate(a)):
        assert sorted(i for x in child for i in x) == list(range(120)) and all(island.load(x) <= 1000 for x in child)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, " \n"), (3, None), (4, "word " * 30000)], "doc_id bigint, text string")
    got = {r[0]: r[1] for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] >= 30000


def test_evolution_beats_best_fit():
    """Where best fit misses the bound, crossover and migration between islands use fewer bins."""
    rng = random.Random(1)
    sizes = [rng.randint(410, 1024) for _ in range(400)]
    first = packing.Island(sizes, 2048, 1).first(False)
    best: list = []
    for epoch in range(packing.EPOCHS):
        best = packing.Island(sizes, 2048, epoch).evolve([best] if best else [])
    assert packing.Island(sizes, 2048, 1).least < len(best) < len(first)
    assert sorted(i for b in best for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 2048 for b in best)
