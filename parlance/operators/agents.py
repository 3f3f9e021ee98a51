"""Sessions of agents: turns with their tools, step fingerprints, loops, signals, kinds, efficiency and effectiveness.

Turns are rows (session_id, turn_no, role, text, tools, paths, failed, raw). Sessions without an identifier are left out; a null or damaged
content has no text and no tools; empty tables give empty tables. Windows go by session; a session's turns are bounded by its log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import sessions

# Words of an error, answers without information, greetings and closings, confirmations.
ERROR_WORDS = ["error", "Error", "ERROR", "traceback", "Traceback", "failed", "Failed", "FAILED", "exception", "Exception"]
LOW_INFO = r"(?i)^(?:(?:ok|okay|sure|yes|yeah|yep|right)\b|(?:try again|retry|再试|继续|好的|可以|行)\s*$|(?:do it|go ahead|proceed)\s*$)"
GREETING = r"(?i)^(?:(?:hey|hi|hello|sup|yo)\b|(?:你好|嗨|哈喽)|(?:good morning|good afternoon|good evening))"
SIGN_OFF = r"(?i)^(?:(?:thanks|thank you|thx|ty)\b|(?:bye|goodbye|see you|cya)\b|(?:谢谢|拜拜|再见|辛苦了|收工)|(?:lgtm|looks good|perfect|great)\s*[!.]*$)"
CONFIRMATION = r"(?i)^(?:yes|yeah|yep|ok|okay|sure|right|good|fine|lgtm|looks good|好的|好|可以|行|对|嗯|没问题|继续)\s*[!.?]*$"
# The weights of a turn's signals that differ by kind of session.
KIND_WEIGHTS: dict[str, dict[str, float]] = {
    "debugging": {"error": 0.25, "tool": 0.15, "position": 0.10},
    "implementation": {"tool": 0.30, "shift": 0.10},
    "exploratory": {"shift": 0.30, "unique": 0.20, "length": 0.05, "tool": 0.15},
    "review": {"position": 0.25, "tool": 0.10},
}
FORWARD = ["next", "todo", "now let's", "then ", "after that", "move on", "接下来", "然后", "下一步", "之后", "待办"]
_BLOCKS = "array<struct<type:string,text:string,name:string,input:struct<file_path:string>>>"


def _said(df: DataFrame) -> DataFrame:
    """The turns of logged lines, not yet numbered."""
    c = F.col("message.content")
    rows = df.filter(F.col("type").isin("user", "assistant") & F.col("message").isNotNull() & F.col("session_id").isNotNull())
    whole = F.when(F.ltrim(c).startswith("[") & F.try_parse_json(c).isNotNull(), c)
    rows = rows.select("session_id", "rec_id", F.col("type").alias("role"), F.col("timestamp").alias("raw"), c.alias("c"), F.from_json(whole, _BLOCKS).alias("b"))
    none = F.array().cast("array<string>")
    used = F.when(F.col("role") == "assistant", F.filter("b", lambda x: x["type"] == "tool_use"))
    text = F.when(F.col("b").isNull(), F.col("c")).otherwise(F.array_join(F.transform(F.filter("b", lambda x: x["type"] == "text"), lambda x: x["text"]), " "))
    rows = rows.select("session_id", "rec_id", "role", "raw", text.alias("text"), F.coalesce(F.transform(used, lambda x: x["name"]), none).alias("tools"), F.coalesce(F.transform(used, lambda x: x["input"]["file_path"]), none).alias("paths"))
    return rows.withColumn("failed", (F.col("role") == "assistant") & F.coalesce(F.col("text").rlike("[Ee]rror|[Tt]raceback"), F.lit(False)))


def turns_of_lines(df: DataFrame) -> DataFrame:
    """Turns of logged lines (rec_id, session_id, type, timestamp, message), in order of arrival."""
    return sessions.numbered(_said(df), "session_id", ["rec_id"])


def fingerprint(tools: Column, paths: Column, failed: Column) -> Column:
    """Tool(file):err of each call, joined by arrows; null without calls. Only the last part of a path counts."""
    base = lambda p: F.coalesce(F.substring_index(p, "/", -1), F.lit(""))
    call = lambda t, p: F.concat(F.coalesce(t, F.lit("")), F.when(base(p) != "", F.concat(F.lit("("), base(p), F.lit(")"))).otherwise(""), F.when(failed, ":err").otherwise(""))
    return F.when(F.size(tools) > 0, F.array_join(F.zip_with(tools, paths, call), "→"))


def loops(turns: DataFrame) -> DataFrame:
    """(session_id, start_turn, end_turn, loops, fingerprint, tool) of repeated steps: pairs twice or more, single ones three times or more."""
    w = Window.partitionBy("session_id").orderBy("turn_no")
    steps = turns.filter(F.col("role") == "assistant").withColumn("step", fingerprint(F.col("tools"), F.col("paths"), F.col("failed"))).filter(F.col("step").isNotNull())
    steps = steps.select("session_id", "turn_no", "step", F.col("tools")[0].alias("tool"), F.row_number().over(w).cast("bigint").alias("i"))
    found = sessions.loops(steps, "session_id", ["turn_no"], "step", "turn_no")
    at = lambda to, more=(): steps.select("session_id", F.col("i").alias(to + "_at"), F.col("turn_no").alias(to + "_turn"), *more)
    out = found.join(at("start", ("tool",)), ["session_id", "start_at"]).join(at("end"), ["session_id", "end_at"])
    return out.select("session_id", "start_turn", "end_turn", "loops", "fingerprint", "tool")


def _signalled(turns: DataFrame) -> DataFrame:
    """turns with user_no, n_users and the position, length, tool and error signals, which count for user turns only; user_no is null for others."""
    whole = Window.partitionBy("session_id")
    w = whole.orderBy("turn_no")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), whole.orderBy(F.desc("turn_no")).rowsBetween(Window.unboundedPreceding, -1)
    mine = lambda c: F.when(F.col("role") == "assistant", c)
    user, chars = F.col("role") == "user", F.length(F.coalesce("text", F.lit("")))
    # What lies ahead comes first: all that follows goes by the order that the turns are in then.
    d = turns.withColumn("_calls", F.last(mine(F.size("tools")), True).over(ahead)).withColumns({
        "user_no": F.when(user, F.count_if(user).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1), "n_users": F.count_if(user).over(whole), "_median": F.median(F.when(user, chars)).over(whole),
        "_bad": F.last(mine(F.col("failed")), True).over(back),
    })
    said = X.strip_ascii(F.coalesce("text", F.lit("")))
    n, of = F.col("user_no"), F.col("n_users")
    position = F.when((of > 1) & (n == 0) & said.rlike(GREETING), 0.0).when((of > 1) & (n == of - 1) & said.rlike(SIGN_OFF), 0.0).otherwise(sessions.position_signal(n, of))
    length = F.when(F.col("_median") > 0, F.least(chars / F.col("_median"), F.lit(1.0))).otherwise(1.0)
    error = F.when(F.coalesce("_bad", F.lit(False)) & ~((F.length(said) < 20) & said.rlike(LOW_INFO)), 1.0).otherwise(0.0)
    return d.withColumns({"position": position, "length": length, "tool": F.least(F.coalesce("_calls", F.lit(0)) / 5, F.lit(1.0)), "error": error}).drop("_calls", "_bad", "_median")


def signals(turns: DataFrame) -> DataFrame:
    """User turns with position, length, tool and error signals between 0 and 1."""
    return _signalled(turns).filter(F.col("role") == "user")


def _ratios() -> dict[str, Column]:
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    said = F.coalesce("text", F.lit(""))
    of = lambda who, c: F.avg(F.when(who, c.cast("double")))
    return {
        "n_users": F.count_if(user),
        "n_assistants": F.count_if(assistant),
        "error_rate": of(assistant, F.col("failed")),
        "tool_rate": of(assistant, F.size("tools") > 0),
        "question_rate": of(user, X.strip_ascii(said).endswith("?")),
        "user_chars": of(user, F.length(said)),
        "confirm_rate": of(user, X.strip_ascii(said).rlike(CONFIRMATION)),
    }


def ratios(turns: DataFrame) -> DataFrame:
    """(session_id, n_users, n_assistants, error_rate, tool_rate, question_rate, user_chars, confirm_rate)."""
    return turns.groupBy("session_id").agg(*[c.alias(k) for k, c in _ratios().items()])


def kind(shift: Column) -> Column:
    """The kind of a session of `ratios`, by rules in order; null if none holds. shift: the mean semantic shift of its user turns."""
    known = (F.col("n_users") > 0) & (F.col("n_assistants") > 0)
    return (
        F.when(~known, None)
        .when(F.col("error_rate") > 0.30, "debugging")
        .when((F.col("tool_rate") > 0.40) & (F.col("user_chars") > 50), "implementation")
        .when((F.col("question_rate") > 0.30) & (shift > 0.60), "exploratory")
        .when((F.col("confirm_rate") > 0.40) & (F.col("tool_rate") < 0.15), "review")
    )


def weight(signal: str, of: Column) -> Column:
    """The weight of a signal in sessions of a kind."""
    out = F.lit(sessions.WEIGHTS[signal])
    for k, w in KIND_WEIGHTS.items():
        if signal in w:
            out = F.when(of == k, w[signal]).otherwise(out)
    return out


def distilled(turns: DataFrame, least: float = 0.3, columns: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """turns with kind, importance, kept and the signals: six signals weighed by kind of session (see `sessions.distil`).

    Only `columns` of the turns are carried along, all if not given, and `more`, made of them, user_no and n_users. Turns are sent by
    session twice, and nothing is joined.
    """
    words = F.filter(F.split(F.lower(F.coalesce("_text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 2)
    more = more or {}
    columns = [c for c in (columns or turns.columns) if c not in ("session_id", "turn_no", "role", *more)]
    names = list(_ratios())
    d = _signalled(turns).withColumns({k: c.over(Window.partitionBy("session_id")) for k, c in _ratios().items()})
    kept = ["session_id", "turn_no", "role", *columns, *more, "user_no", "position", "length", "tool", "error", *names]
    # Of an assistant's text nothing is compared.
    d = d.withColumns({**more, "_text": F.when(F.col("role") == "user", F.col("text"))}).select(*kept, "_text")
    d = sessions.with_semantic_signals(d, "session_id", "turn_no", "user_no", words, kept)
    shift = F.avg("shift").over(Window.partitionBy("session_id"))
    d = d.withColumn("kind", kind(F.coalesce(shift, F.lit(0.0)))).drop(*names)
    weighed = {n: F.coalesce(n, F.lit(0.0)) * weight(n, F.col("kind")) for n in sessions.WEIGHTS}
    # Each signal is weighed by its session's kind already.
    return sessions.distil(d, "session_id", "turn_no", {k: v * len(weighed) for k, v in weighed.items()}, dict.fromkeys(weighed, 1.0), least).drop("user_no")


def final_status(turns: DataFrame) -> DataFrame:
    """(session_id, status): error if one of the last three assistant turns among the last twenty turns tells of one, else success."""
    last = turns.filter((F.col("role") == "assistant") & (F.col("turn_no") >= F.col("n_turns") - 20))
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_no"))
    last = last.withColumn("_k", F.row_number().over(w)).filter("_k <= 3")
    bad = F.max(F.coalesce(F.col("text").rlike("|".join(ERROR_WORDS)), F.lit(False)))
    every = turns.select("session_id").distinct()
    return every.join(last.groupBy("session_id").agg(bad.alias("_bad")), "session_id", "left").select("session_id", F.when(F.coalesce("_bad", F.lit(False)), "error").otherwise("success").alias("status"))


def effectiveness(status: Column, seconds: Column, calls: Column, errors: Column, specificity: Column | None = None) -> Column:
    """Between 0 and 1: a clean end, a sensible length, tools used, few errors among them, specific prompts."""
    score = (
        F.when(status == "success", 0.30).when(status == "unknown", 0.15).otherwise(0.0)
        + F.when(seconds.between(600, 7200), 0.15).when(seconds > 7200, 0.05).otherwise(0.0)
        + F.when(calls > 0, 0.10 + 0.25 * F.greatest(1 - 2 * errors / calls, F.lit(0.0))).otherwise(0.0)
        + 0.20 * F.least(F.lit(0.5) if specificity is None else specificity, F.lit(1.0))
    )
    return F.round(F.least(score, F.lit(1.0)), 2)


def stars(score: Column) -> Column:
    """Five stars, filled by a score between 0 and 1 (halves to the even number)."""
    n = F.bround(score * 5).cast("int")
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(5) - n))


def efficiency(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, n_turns, n_users, n_calls, n_errors, n_loops, in_loops, productive, calls_per_user, recovered) of turns and their loops."""
    inside = found.select("session_id", F.explode(F.sequence("start_turn", "end_turn")).alias("turn_no")).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("in_loops"))
    user = F.col("role") == "user"
    base = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(user).alias("n_users"), F.sum(F.size("tools")).cast("bigint").alias("n_calls"), F.count_if(F.col("failed")).alias("n_errors"), F.max("turn_no").alias("_last"))
    many = found.join(base.select("session_id", "_last"), "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_loops"), F.count_if(F.col("end_turn") < F.col("_last")).alias("_over"))
    d = base.join(inside, "session_id", "left").join(many, "session_id", "left").fillna(0, ["in_loops", "n_loops", "_over"])
    return d.select(
        "session_id", "n_turns", "n_users", "n_calls", "n_errors", "n_loops", "in_loops",
        F.round((F.col("n_turns") - F.col("in_loops")) / F.col("n_turns"), 2).alias("productive"),
        F.when(F.col("n_users") > 0, F.round(F.col("n_calls") / F.col("n_users"), 1)).otherwise(0.0).alias("calls_per_user"),
        F.when(F.col("n_loops") > 0, F.round(F.col("_over") / F.col("n_loops"), 2)).otherwise(1.0).alias("recovered"),
    )


def frustration(turns: DataFrame) -> DataFrame:
    """(session_id, n, first_rate, second_rate, abandoned, escalated, stalls) of assistant turns; a stall has no tools and under 50 characters."""
    a = turns.filter(F.col("role") == "assistant").drop("n_turns")
    g = sessions.frustration(a.withColumnRenamed("turn_no", "_turn"), "session_id", ["_turn"], F.col("failed"))
    stall = (F.size("tools") == 0) & (F.length(X.strip_ascii(F.coalesce("text", F.lit("")))) < 50)
    return g.join(a.groupBy("session_id").agg(F.count_if(stall).alias("stalls")), "session_id")


def summaries(turns: DataFrame) -> DataFrame:
    """(session_id, productive, focus, effectiveness, abandoned, escalated, stalls) of turns with their instants `at`: what `efficiency`,
    `distilled`, `final_status`, `effectiveness` and `frustration` say of each session, in one aggregation.

    Turns are sent by session twice, as in `distilled`, and nothing is joined.
    """
    said = F.coalesce("text", F.lit(""))
    assistant = F.col("role") == "assistant"
    d = turns.withColumn("_step", F.when(assistant, fingerprint(F.col("tools"), F.col("paths"), F.col("failed"))))
    d = sessions.in_loops(d, "session_id", ["turn_no"], "_step")
    # The turns between the first and the last step of a loop are lost as well.
    lost = F.when(F.col("ends"), F.col("turn_no") + 1).when(F.col("begins"), -F.col("turn_no")).otherwise(0)
    mine = Window.partitionBy("session_id", "role")
    d = d.withColumns({"_lost": lost, "_no": F.row_number().over(mine.orderBy("turn_no")) - 1, "_of": F.count(F.lit(1)).over(mine)})
    d = d.withColumns({
        "_used": F.size("tools"), "_stall": assistant & (F.size("tools") == 0) & (F.length(X.strip_ascii(said)) < 50),
        "_said_error": assistant & (F.col("_no") >= F.col("_of") - 3) & (F.col("turn_no") >= F.col("n_turns") - 20) & F.coalesce(F.col("text").rlike("|".join(ERROR_WORDS)), F.lit(False)),
    })
    d = distilled(d, columns=["failed", "at", "_lost", "_no", "_of", "_used", "_stall", "_said_error"])
    half, f = F.expr("_of div 2"), F.col("failed").cast("int")
    rate = lambda cond: F.avg(F.when(assistant & cond, f))
    g = d.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("_lost").alias("in_loops"), F.avg(F.col("kept").cast("double")).alias("focus"), F.sum("_used").cast("bigint").alias("n_calls"), F.count_if(F.col("failed")).alias("n_errors"),
        F.expr("(max(at) - min(at)) div 1000000").alias("seconds"), F.when(F.max("_said_error"), "error").otherwise("success").alias("status"), F.count_if(assistant).alias("n"),
        rate(F.col("_no") < half).alias("first_rate"), rate(F.col("_no") >= half).alias("second_rate"), F.coalesce(F.sum(F.when(assistant & (F.col("_no") >= F.col("_of") - 3), f)) == 3, F.lit(False)).alias("abandoned"), F.count_if(F.col("_stall")).alias("stalls"),
    )
    return g.select(
        "session_id", F.round((F.col("n_turns") - F.col("in_loops")) / F.col("n_turns"), 2).alias("productive"), "focus", effectiveness(F.col("status"), F.col("seconds"), F.col("n_calls"), F.col("n_errors")).alias("effectiveness"),
        "abandoned", sessions.grown(F.col("n"), F.col("first_rate"), F.col("second_rate")).alias("escalated"), "stalls",
    )


def insight(quality: Column, efficiency_: Column) -> Column:
    """One line on a session with the columns of `frustration`; quality and efficiency between 0 and 100."""
    return (
        F.when(F.col("abandoned"), "ended in errors")
        .when(F.col("escalated"), "errors grew")
        .when(F.col("stalls") >= 5, F.concat(F.col("stalls").cast("string"), F.lit(" stalls")))
        .when(efficiency_ < 50, "loops")
        .when(quality >= 80, "focused")
        .when(quality >= 60, "solid")
        .when(quality >= 40, "fair")
        .otherwise("rough")
    )


#: Characters of a decision or an action.
BRIEF = 120


def _looks_ahead() -> Column:
    """Whether the text has a word on what comes next."""
    ahead = F.lit(False)
    for k in FORWARD:
        ahead |= F.lower("text").contains(k)
    return F.coalesce(ahead, F.lit(False))


def export(kept: DataFrame, most: int = 5) -> DataFrame:
    """(session_id, goal, decisions, actions, resume, files, n_turns, n_kept, n_tokens) of `distilled` turns: what a next session must know.

    goal: the first user turn; decisions and actions: of the `most` weightiest kept user turns those whose shift is at least the tool
    signal, and the others; resume: the last of the final three user turns with a word on what comes next.
    """
    v = Window.partitionBy("session_id", "role").orderBy(F.desc("turn_no"))
    d = kept.withColumns({"_resumes": (F.col("role") == "user") & (F.row_number().over(v) <= 3) & _looks_ahead(), "_chars": F.length("text")})
    return _gathered(d, most)


def exports(lines: DataFrame, most: int = 5) -> DataFrame:
    """`export` of the distilled turns of logged lines.

    Assistants' texts are not sent, only their lengths; of users' texts only the goal and what may be resumed are carried whole past the signals.
    """
    user = F.col("role") == "user"
    t = _said(lines).withColumns({"text": F.when(user, F.col("text")), "_chars": F.length("text")})
    resumes = F.coalesce((F.col("user_no") >= F.col("n_users") - 3) & _looks_ahead(), F.lit(False))
    text = F.when((F.col("user_no") == 0) | resumes, F.col("text")).otherwise(F.substring("text", 1, BRIEF))
    d = distilled(sessions.numbered(t, "session_id", ["rec_id"]), columns=["paths", "_chars"], more={"_resumes": resumes, "_brief": text})
    return _gathered(d.withColumnRenamed("_brief", "text"), most)


def _gathered(kept: DataFrame, most: int) -> DataFrame:
    """See `export`; _resumes: whether a turn is one of those to resume from, _chars: the length of its text."""
    user = F.col("role") == "user"
    w = Window.partitionBy("session_id").orderBy(F.desc(F.when(user & F.col("kept"), F.col("importance"))), "turn_no")
    d = kept.withColumn("_rank", F.row_number().over(w))
    decided = F.coalesce("shift", F.lit(0.0)) >= F.coalesce("tool", F.lit(0.0))
    top = user & F.col("kept") & (F.col("_rank") <= most)
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn_no", F.substring("text", 1, BRIEF).alias("t"))))), lambda x: x["t"])
    return d.groupBy("session_id").agg(
        F.min(F.when(user, F.struct("turn_no", "text")))["text"].alias("goal"),
        texts(top & decided).alias("decisions"),
        texts(top & ~decided).alias("actions"),
        F.max(F.when(F.col("_resumes"), F.struct("turn_no", "text")))["text"].alias("resume"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("files"),
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("kept")).alias("n_kept"),
        F.floor(F.sum(F.when(F.col("kept"), F.col("_chars"))) / 4).cast("bigint").alias("n_tokens"),
    )
