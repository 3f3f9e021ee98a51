"""Operators over ordered turns of sessions, as window expressions.

Running frames stream through a partition, so a long session costs time in its task but no memory. Null sessions form a session
of their own; ties of the order column are broken by the tie column; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.session import materialize

# Weights of the signals of a turn, and of the parts of a session's quality.
WEIGHTS = {"position": 0.15, "length": 0.15, "tool": 0.20, "error": 0.15, "shift": 0.20, "unique": 0.15}
QUALITY = {"prompt": 0.30, "efficiency": 0.30, "focus": 0.20, "outcome": 0.20}


def numbered(df: DataFrame, session: str, order: list[str]) -> DataFrame:
    """df with turn_no from 0 and n_turns of the session (BIGINT)."""
    w = Window.partitionBy(session).orderBy(*order)
    return df.withColumn("turn_no", (F.row_number().over(w) - 1).cast("bigint")).withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy(session)))


def position_signal(no: Column, n: Column) -> Column:
    """1 for a single or first turn, 0.8 for the last, else 0.3 and up to 0.2 more towards the end."""
    return F.when((n == 1) | (no == 0), 1.0).when(no == n - 1, 0.8).otherwise(0.3 + 0.2 * no / (n - 1))


def neighbours(df: DataFrame, session: str, order: list[str], role: str, column: str) -> DataFrame:
    """df with the column of the nearest user turn before and after each row, and of the next and previous assistant turn."""
    w = Window.partitionBy(session).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(session).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    of = lambda who: F.when(F.col(role) == who, F.col(column))
    return df.withColumns({
        "user_before": F.last(of("user"), ignorenulls=True).over(back),
        "user_after": F.last(of("user"), ignorenulls=True).over(ahead),
        "assistant_before": F.last(of("assistant"), ignorenulls=True).over(back),
        "assistant_after": F.last(of("assistant"), ignorenulls=True).over(ahead),
    })


def carry_forward(df: DataFrame, session: str, order: list[str], column: str, to: str) -> DataFrame:
    """df with the last value of column up to each row that is not null."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.last(column, ignorenulls=True).over(w))


def quality(parts: dict[str, Column], weights: dict[str, float] = QUALITY) -> Column:
    """Weighted mean of the parts that are not null; null if all are."""
    total = sum((F.when(parts[k].isNotNull(), parts[k] * w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def frustration(df: DataFrame, session: str, order: list[str], failed: Column) -> DataFrame:
    """(session, n, first_rate, second_rate, abandoned, escalated): whether the last three steps all failed, and whether failures grew
    from the first half to the second (by half, and above a fifth; four steps or more)."""
    d = numbered(df.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("int")), session, order)
    half = F.expr("n_turns div 2")
    rate = lambda cond: F.avg(F.when(cond, F.col("_f")))
    g = d.groupBy(session).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("turn_no") < half).alias("first_rate"),
        rate(F.col("turn_no") >= half).alias("second_rate"),
        (F.sum(F.when(F.col("turn_no") >= F.col("n_turns") - 3, F.col("_f"))) == 3).alias("abandoned"),
    )
    return g.withColumn("escalated", grown(F.col("n"), F.col("first_rate"), F.col("second_rate")))


def grown(n: Column, first: Column, second: Column) -> Column:
    """Whether failures grew from a first rate to a second one, over n steps."""
    return F.coalesce((n >= 4) & (second > 1.5 * first) & (second > 0.2), F.lit(False))


def two_step_loops(df: DataFrame, session: str, order: list[str], step: str, index: str) -> DataFrame:
    """(session, start_at, end_at, loops, fingerprint): steps A, B, A, B and so on, twice or more, found from left to right.

    Where a step equals the one before last, an alternating region goes on. Regions that follow each other share one step; the
    later one loses it if the earlier took it, which flips with every region of even length: a running sum modulo 2.
    """
    w = Window.partitionBy(session).orderBy(*order)
    d = df.filter(F.col(step).isNotNull()).select(session, *order, step, index, F.row_number().over(w).alias("_i"), F.lag(step, 1).over(w).alias("_p1"), F.lag(step, 2).over(w).alias("_p2"), F.lag(index, 2).over(w).alias("_x2"))
    d = d.filter((F.col(step) == F.col("_p2")) & (F.col(step) != F.col("_p1")))
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(session).orderBy("_i")))
    r = d.groupBy(session, "_g").agg((F.min("_i") - 2).alias("_s"), F.max("_i").alias("_e"), F.min(F.struct("_i", "_p2", "_p1")).alias("_f"))
    r = r.withColumn("_len", F.col("_e") - F.col("_s") + 1)
    v = Window.partitionBy(session).orderBy("_s")
    joined = (F.col("_s") == F.lag("_e").over(v)) & (F.lag("_len").over(v) >= 4)
    r = r.withColumn("_reset", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_even", F.when((F.col("_len") >= 4) & (F.col("_len") % 2 == 0), 1).otherwise(0))
    r = r.withColumn("_chain", F.sum("_reset").over(v))
    r = r.withColumn("_shift", F.coalesce(F.sum("_even").over(Window.partitionBy(session, "_chain").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    r = r.withColumn("loops", F.expr("(_len - _shift) div 2")).filter("loops >= 2")
    first, second = F.when(F.col("_shift") == 0, F.col("_f._p2")).otherwise(F.col("_f._p1")), F.when(F.col("_shift") == 0, F.col("_f._p1")).otherwise(F.col("_f._p2"))
    return r.select(session, (F.col("_s") + F.col("_shift")).cast("bigint").alias("start_at"), (F.col("_s") + F.col("_shift") + 2 * F.col("loops") - 1).cast("bigint").alias("end_at"), F.col("loops").cast("bigint"), F.concat(first, F.lit("->"), second).alias("fingerprint"))


def single_step_loops(df: DataFrame, session: str, order: list[str], step: str, least: int = 3) -> DataFrame:
    """(session, start_at, end_at, loops, fingerprint): runs of `least` equal steps or more; positions count from 1."""
    w = Window.partitionBy(session).orderBy(*order)
    d = df.filter(F.col(step).isNotNull()).select(session, F.col(step).alias("fingerprint"), *[c for c in order if c not in (session, step)], F.row_number().over(w).alias("_i"))
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(session, "fingerprint").orderBy("_i")))
    g = d.groupBy(session, "fingerprint", "_g").agg(F.min("_i").cast("bigint").alias("start_at"), F.max("_i").cast("bigint").alias("end_at"), F.count(F.lit(1)).alias("loops"))
    return g.filter(F.col("loops") >= least).drop("_g")


def loops(df: DataFrame, session: str, order: list[str], step: str, index: str) -> DataFrame:
    """Two-step loops, and single-step loops among the steps that those leave."""
    two = two_step_loops(df, session, order, step, index)
    w = Window.partitionBy(session).orderBy(*order)
    d = df.filter(F.col(step).isNotNull()).select(session, F.col(step).alias("fingerprint"), F.row_number().over(w).cast("bigint").alias("_i"))
    used = two.select(F.col(session), F.explode(F.sequence("start_at", "end_at")).alias("_i"))
    d = d.join(used, [session, "_i"], "left_anti")
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(session, "fingerprint").orderBy("_i")))
    one = d.groupBy(session, "fingerprint", "_g").agg(F.min("_i").alias("start_at"), F.max("_i").alias("end_at"), F.count(F.lit(1)).alias("loops")).filter("loops >= 3")
    return two.unionByName(one.select(*two.columns))


def in_loops(df: DataFrame, session: str, order: list[str], step: str) -> DataFrame:
    """df with in_loop, begins and ends: whether the row's step belongs to one of `loops`, is its first, is its last.

    Only windows by session, so nothing is joined and rows stay where their session is. A row of an alternating region knows its ends;
    the two steps before its first row, which belong to it as well, read them from the rows ahead.
    """
    cols = df.columns
    d = df.withColumn("_has", F.col(step).isNotNull())
    by = Window.partitionBy(session, "_has")
    w = by.orderBy(*order)
    past, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    no = F.lit(False)
    d = d.withColumns({"_i": F.row_number().over(w), "_p1": F.lag(step, 1).over(w), "_p2": F.lag(step, 2).over(w)})
    d = d.withColumn("_alt", F.coalesce((F.col(step) == F.col("_p2")) & (F.col(step) != F.col("_p1")), no))
    d = d.withColumn("_g", F.count_if(~F.col("_alt")).over(so_far))
    region = Window.partitionBy(session, "_has", "_g")
    at = F.when(F.col("_alt"), F.col("_i"))
    d = d.withColumns({"_s": F.min(at).over(region) - 2, "_e": F.max(at).over(region)}).withColumn("_len", F.col("_e") - F.col("_s") + 1)
    # See two_step_loops: of regions that share a step, the later one loses it if the earlier took it.
    d = d.withColumns({"_pe": F.last(F.when(F.col("_alt"), F.col("_e")), True).over(past), "_pl": F.last(F.when(F.col("_alt"), F.col("_len")), True).over(past)})
    first = F.col("_alt") & (F.col("_i") == F.col("_s") + 2)
    reset = first & ~F.coalesce((F.col("_pe") == F.col("_s")) & (F.col("_pl") >= 4), no)
    even = ((F.col("_len") >= 4) & (F.col("_len") % 2 == 0)).cast("int")
    d = d.withColumn("_evens", F.sum(F.when(first, even).otherwise(0)).over(so_far) - even)
    d = d.withColumn("_base", F.last(F.when(reset, F.col("_evens")), True).over(so_far))
    d = d.withColumn("_start", F.col("_s") + (F.col("_evens") - F.col("_base")) % 2).withColumn("_n", F.expr("(_e - _start + 1) div 2"))
    whole = F.col("_alt") & (F.col("_n") >= 2)
    d = d.withColumns({"_start": F.when(whole, F.col("_start")), "_end": F.when(whole, F.col("_start") + 2 * F.col("_n") - 1)})
    ends = [(F.col("_start"), F.col("_end")), *((F.lead("_start", k).over(w), F.lead("_end", k).over(w)) for k in (1, 2))]
    inside = [F.when(F.col("_i").between(a, b), F.struct(a.alias("a"), b.alias("b"))) for a, b in ends]
    d = d.withColumn("_two", F.coalesce(*inside)).withColumn("_end", F.col("_two.b"))
    d = d.withColumn("_eq", F.coalesce((F.col(step) == F.col("_p1")) & F.col("_end").isNull() & F.lag("_end").over(w).isNull(), no))
    near = lambda c: F.coalesce(c.over(w), no)
    d = d.withColumns({"_b": near(F.lag("_eq")), "_a1": near(F.lead("_eq")), "_a2": near(F.lead("_eq", 2))})
    single = (F.col("_eq") & (F.col("_b") | F.col("_a1"))) | (F.col("_a1") & F.col("_a2"))
    is_ = lambda k, one: F.coalesce(F.col("_i") == F.col(f"_two.{k}"), single & ~F.col(one))
    return d.select(*cols, (F.col("_end").isNotNull() | single).alias("in_loop"), is_("a", "_eq").alias("begins"), is_("b", "_a1").alias("ends"))


def within_loops(df: DataFrame, found: DataFrame, session: str, position: str) -> DataFrame:
    """The distinct rows of df whose position lies in a loop of their session (an interval semi-join by session and position)."""
    inside = found.select(session, F.explode(F.sequence("start_at", "end_at")).alias(position)).distinct()
    return df.join(inside, [session, position], "left_semi")


# Distillation -------------------------------------------------------------------------------------------------------------------
#: Turns of a block: each pair of blocks of a session is a group of its own, so a long session is spread over tasks.
BLOCK = 256
#: Terms of a block that are laid out densely at once.
TERMS = 4096


def _products(codes: list, weights: list, rows: list, n_terms: int, step: int) -> np.ndarray:
    """The inner products of two sides' sparse vectors (codes, weights and row numbers from 0 of each side)."""
    n = [int(r.max()) + 1 if len(r) else 0 for r in rows]
    out = np.zeros(n)
    for start in range(0, n_terms, step):
        dense = []
        for c, w, r, k in zip(codes, weights, rows, n, strict=True):
            here = (c >= start) & (c < start + step)
            m = np.zeros((k, min(step, n_terms - start)))
            m[r[here], c[here] - start] = w[here]
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def nearest_earlier(vectors: DataFrame, session: str, turn: str) -> DataFrame:
    """(_k, _m): the greatest cosine of each turn that has terms with an earlier such turn of its session; first turns are not listed.

    vectors: (_k, term, w) of length one, _k a struct of session and turn. All pairs of a session are multiplied, block by block.
    """
    kind, at = (vectors.schema["_k"].dataType[c].dataType.simpleString() for c in (session, turn))
    v = vectors.groupBy("_k").agg(F.collect_list(F.struct("term", "w")).alias("_v")).select(F.col(f"_k.{session}").alias("s"), F.col(f"_k.{turn}").alias("t"), "_v.term", "_v.w")
    v = v.withColumn("block", F.floor(F.col("t") / BLOCK))
    known = v.groupBy("s").agg(F.collect_set("block").alias("blocks"))
    pair = lambda x: F.struct(F.greatest("block", x).alias("hi"), F.least("block", x).alias("lo"))
    v = v.join(known, "s").select("s", "t", "term", "w", "block", F.explode(F.transform("blocks", pair)).alias("p")).select("s", "t", "term", "w", "block", "p.hi", "p.lo")

    step = TERMS

    def run(table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        block, hi, lo = table.column("block").to_numpy(), table.column("hi")[0].as_py(), table.column("lo")[0].as_py()
        terms = table.column("term").combine_chunks()
        size = np.diff(terms.offsets.to_numpy())
        coded = terms.flatten().dictionary_encode()
        code, weight, row = coded.indices.to_numpy(), table.column("w").combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(t)), size)
        sides = [np.flatnonzero(block == x) for x in (hi, lo)]
        number = np.zeros(len(t), np.int64)
        parts = []
        for side in sides:
            inside = np.isin(row, side)
            number[side] = np.arange(len(side))
            parts.append((code[inside], weight[inside], number[row[inside]]))
        m = _products(*[[p[i] for p in parts] for i in range(3)], len(coded.dictionary), step)
        m[t[sides[1]][None, :] >= t[sides[0]][:, None]] = -1
        best = m.max(axis=1) if m.size else np.zeros(0)
        keep = best >= 0
        return pa.table({"s": table.column("s").take(pa.array(sides[0][keep])), "t": pa.array(t[sides[0]][keep]), "m": pa.array(best[keep])})

    found = v.groupBy("s", "hi", "lo").applyInArrow(run, f"s {kind}, t {at}, m double")
    return found.groupBy(F.struct(F.col("s").alias(session), F.col("t").alias(turn)).alias("_k")).agg(F.max("m").alias("_m"))


#: Up to so many turns of a session all pairs that share a term are listed; beyond, its turns are multiplied.
FEW = 16


def _semantic(turn: np.ndarray, first: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """shift and unique of turns in order; first: where a session begins."""
    n, size = len(turn), np.diff(lists.offsets.to_numpy())
    of, has = np.cumsum(first) - 1, size > 0
    coded = lists.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    key, c = np.unique(np.repeat(np.arange(n), size) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, code = key // width, key % width
    _, term, df = np.unique(of[row] * width + code, return_inverse=True, return_counts=True)
    w = (1 + np.log(c)) * (np.log((1.0 + np.bincount(of, has)[of[row]]) / (1 + df[term])) + 1)
    w /= np.sqrt(np.bincount(row, w * w, n))[row]
    begins = np.flatnonzero(first)
    length = np.diff(np.append(begins, n))
    before, best = np.zeros(n), np.zeros(n)

    few = np.flatnonzero((length <= FEW)[of[row]])
    few = few[np.lexsort((row[few], term[few]))]
    if len(few):
        t = np.append(np.flatnonzero(np.diff(term[few], prepend=-1)), len(few))
        back = np.arange(len(few)) - np.repeat(t[:-1], np.diff(t))
        later = np.repeat(np.arange(len(few)), back)
        earlier = later - 1 - (np.arange(len(later)) - np.repeat(np.cumsum(back) - back, back))
        i, j = few[later], few[earlier]
        m = np.bincount(row[i] * FEW + row[i] - row[j] - 1, w[i] * w[j], n * FEW).reshape(n, FEW).astype(float)  # of nothing, bincount counts in integers
        before, best = m[:, 0].copy(), m.max(axis=1)
    for k in np.flatnonzero(length > FEW):
        low, high = np.searchsorted(row, (begins[k], begins[k] + length[k]))
        terms, mine = np.unique(code[low:high], return_inverse=True)
        side = (mine, w[low:high], row[low:high] - begins[k])
        m = np.zeros((length[k], length[k]))
        p = _products(*[[x, x] for x in side], len(terms), TERMS)
        m[: len(p), : len(p)] = np.tril(p, -1)
        best[begins[k] : begins[k] + length[k]] = m.max(axis=1)
        before[begins[k] + 1 : begins[k] + length[k]] = np.diagonal(m, -1)
    follows = ~first & (np.diff(turn, prepend=0) == 1)
    return np.where(has & (turn > 0), 1 - np.where(follows, before, 0.0), 0.5), 1 - np.minimum(best, 1.0)


def with_semantic_signals(df: DataFrame, session: str, order: str, turn: str, words: Column, names: list[str]) -> DataFrame:
    """The columns `names` of df with shift and unique (see `semantic_signals`) of the rows whose turn is not null, null for others.

    words is made after the windows, so lists of words are never sorted. A session of up to BLOCK rows is looked at as a whole where
    its rows lie, so nothing is joined; longer ones are multiplied by blocks.
    """
    whole = Window.partitionBy(session)
    d = df.withColumns({"_i": F.row_number().over(whole.orderBy(order)), "_n": F.count(F.lit(1)).over(whole)})
    most = BLOCK
    short = d.filter(F.col("_n") <= most).select(*names, "_i", "_n", F.when(F.col(turn).isNotNull(), words).alias("_words"))
    out = T.StructType([*df.select(names).schema.fields, T.StructField("shift", T.DoubleType()), T.StructField("unique", T.DoubleType())])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            i, n = t.column("_i").to_numpy(), t.column("_n").to_numpy()
            if not len(i):
                continue
            cut = len(i) if i[-1] == n[-1] else int(np.flatnonzero(i == 1)[-1])
            held, t = t.slice(cut) if cut < len(i) else None, t.slice(0, cut)
            if not cut:
                continue
            at = np.flatnonzero(t.column(turn).is_valid().to_numpy())
            of = np.cumsum(i[:cut] == 1)[at]
            scores = [np.full(cut, np.nan), np.full(cut, np.nan)]
            if len(at):
                mine = t.select([turn, "_words"]).take(pa.array(at)).combine_chunks()
                lists = pa.concat_arrays(mine.column("_words").chunks)
                for x, y in zip(scores, _semantic(mine.column(turn).to_numpy().astype(np.int64), np.diff(of, prepend=-1) != 0, lists), strict=True):
                    x[at] = y
            t = t.select(names)
            for name, x in zip(("shift", "unique"), scores, strict=True):
                t = t.append_column(name, pa.array(x, from_pandas=True))
            yield from t.to_batches()

    # The windows put each session into one partition; the optimizer may have left another order there.
    done = short.sortWithinPartitions(session, order).mapInArrow(run, out)
    if df.groupBy(session).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).isEmpty():
        return done
    long = d.filter(F.col("_n") > most).drop("_i", "_n")
    found = _long_sessions(long.filter(F.col(turn).isNotNull()), session, turn, words)
    return done.unionByName(long.join(found.hint("merge"), [session, turn], "left").select(*names, "shift", "unique"))


def semantic_signals(turns: DataFrame, session: str, turn: str, tokens: Column) -> DataFrame:
    """(session, turn, shift, unique): how far a turn is from the one before it, and from the nearest earlier one.

    TF-IDF is fitted in each session. shift = 1 - cosine with the turn before (0.5 for the first); unique = 1 - the greatest cosine
    with an earlier turn, 1 without one. Turns without terms have shift 0.5 and unique 1.
    """
    return with_semantic_signals(turns, session, turn, turn, tokens, [session, turn])


def _long_sessions(turns: DataFrame, session: str, turn: str, tokens: Column) -> DataFrame:
    """The signals of `semantic_signals` for sessions that are too long for one task."""
    from parlance.operators import tfidf

    d = turns.select(session, turn, F.struct(session, turn).alias("_k"), tokens.alias("_t"))
    counts = d.select(session, "_k", F.explode("_t").alias("term")).groupBy(session, "_k", "term").agg(F.count(F.lit(1)).alias("c"))
    mine = materialize(tfidf.weights(counts, "_k", group=session).select("_k", "term", "w"), "vectors")
    # A turn meets only the one before it: an equi-join on session, turn and term.
    before = mine.select(F.struct(F.col(f"_k.{session}").alias(session), (F.col(f"_k.{turn}") + 1).alias(turn)).alias("_k"), "term", F.col("w").alias("v"))
    shift = mine.join(before.hint("merge"), ["_k", "term"]).groupBy("_k").agg(F.sum(F.col("w") * F.col("v")).alias("_s"))
    near = nearest_earlier(mine, session, turn)
    known = mine.select("_k", F.lit(True).alias("_has")).distinct()
    out = d.drop("_t").join(known.hint("merge"), "_k", "left").join(shift.hint("merge"), "_k", "left").join(near.hint("merge"), "_k", "left")
    has = F.coalesce("_has", F.lit(False)) & (F.col(turn) > 0)
    return out.select(session, turn, F.when(has, 1 - F.coalesce("_s", F.lit(0.0))).otherwise(0.5).alias("shift"), (1 - F.least(F.coalesce("_m", F.lit(0.0)), F.lit(1.0))).alias("unique"))


def distil(turns: DataFrame, session: str, turn: str, signals: dict[str, Column], weights: dict[str, float] = WEIGHTS, least: float = 0.3) -> DataFrame:
    """turns (role, the signals' columns) with importance and kept.

    A user turn weighs its signals; the only user turn of a session weighs 1. An assistant turn has the mean of the nearest user
    turns before and after it. Kept are user turns of `least` or more, each with the assistant turn right after it.
    """
    user = F.col("role") == "user"
    score = sum((signals[k] * v for k, v in weights.items() if k in signals), F.lit(0.0)) / sum(v for k, v in weights.items() if k in signals)
    whole = Window.partitionBy(session)
    d = turns.withColumn("_u", F.when(user, F.when(F.sum(user.cast("int")).over(whole) == 1, 1.0).otherwise(score)))
    w = whole.orderBy(turn)
    back = F.last("_u", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_ahead", F.last("_u", ignorenulls=True).over(whole.orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, -1)))
    mean = (F.coalesce(back, "_ahead") + F.coalesce("_ahead", back)) / 2
    d = d.withColumn("importance", F.coalesce(F.when(user, F.col("_u")).otherwise(mean), F.lit(0.0)))
    chosen = user & (F.col("importance") >= least)
    follows = ~user & F.coalesce(F.lag(chosen).over(w), F.lit(False))
    return d.withColumn("kept", chosen | follows).drop("_u", "_ahead")
