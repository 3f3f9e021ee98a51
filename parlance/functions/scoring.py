"""Scores of prompts for a model, with suggestions, confirmations, a check against a threshold and an explanation.

All are built-in expressions over the columns of `features.with_features` (or `chinese.with_features`) and, for rules that ask for
it, a task column. Texts are taken as given: blank and null texts score as prompts without features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import features
from parlance.functions import text as X
from parlance.session import materialize

# What a model adds to a score. steps: for asking to think in steps; lean: for text that compression hardly shortens
# (less than `below`); words: for each hundred words beyond `beyond`; complex: for a complexity above `above`.
MODELS: dict[str, dict[str, float]] = {
    "claude": {"lean": 1.0, "below": 0.15},
    "gpt": {"steps": -3.0},
    "gemini": {"words": -1.0, "beyond": 300},
    "small": {"complex": -5.0, "above": 0.5},
}
# Fixed value: the score from which on prompts mostly succeed.
THRESHOLD = 43


def adjustment(model: str, compressible: Column | None = None) -> Column:
    """What the model adds to the total; compressible: the share that compression saves, 0 if it is not given."""
    rules = MODELS.get(model, {})
    parts = [F.lit(0.0)]
    if "steps" in rules:
        parts.append(F.when(F.col("has_steps"), rules["steps"]).otherwise(0.0))
    if "lean" in rules:
        parts.append(F.when((F.lit(0.0) if compressible is None else compressible) < rules["below"], rules["lean"]).otherwise(0.0))
    if "words" in rules:
        parts.append(F.greatest(F.col("n_words") - rules["beyond"], F.lit(0)) / 100 * rules["words"])
    if "complex" in rules:
        parts.append(F.when(F.col("complexity") > rules["above"], rules["complex"]).otherwise(0.0))
    return sum(parts[1:], parts[0])


def _position_value(p: Column) -> Column:
    return F.when(p <= 0.2, 1.0).when(p <= 0.5, 1 - (p - 0.2) / 0.3).otherwise((p - 0.5) / 0.5 * 0.67)


def suggestions(task: Column, position: Column) -> Column:
    """Array of (category, message, impact, points) of what would raise the score, in the order of the parts."""
    coding, building = task.isin("debug", "implement", "refactor", "test"), task.isin("implement", "test")
    rules = [
        (~F.col("has_role"), "structure", "Say which role the model takes", "low", 3),
        (~F.col("has_constraints"), "structure", "Say what must hold and what must not change", "medium", 5),
        (~F.col("has_files") & coding, "context", "Name the files concerned", "high", 6),
        (~F.col("has_errors") & (task == "debug"), "context", "Give the error message as it stands", "high", 6),
        (~F.col("has_edge_cases") & building, "context", "Name edge cases such as empty or null input", "medium", 2),
        ((_position_value(position) < 0.5) & (position > 0.3), "position", "Move the instruction to the start or the end", "high", 10),
        ((F.col("repetition") < 0.1) & (F.col("n_words") > 20), "repetition", "Say the main requirement again at the end", "medium", 8),
        (F.col("ambiguity") > 0.5, "clarity", "Put names in the place of pronouns", "high", 4),
        (F.col("n_words") < 5, "clarity", "Say more: what, where and why", "high", 6),
    ]
    one = lambda when, *v: F.when(when, F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("category", "message", "impact", "points"), strict=True)]))
    return F.array_compact(F.array(*[one(*r) for r in rules]))


def confirmations(parts: dict[str, Column], position: Column) -> Column:
    """Array of (category, message, score) of what a prompt does well."""
    of = lambda name, most: F.concat(F.bround(parts[name]).cast("int").cast("string"), F.lit(f"/{most}"))
    rules = [
        (_position_value(position) >= 0.8, "position", "The instruction stands at the start", of("position", 20)),
        (F.col("has_files"), "context", "Files are named", of("context", 25)),
        (F.col("has_errors"), "context", "The error is given", of("context", 25)),
        (F.col("has_constraints"), "structure", "Constraints are set", of("structure", 15)),
        (F.col("opening") >= 0.4, "clarity", "The opening tells the intent", of("clarity", 25)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("category"), F.lit(m).alias("message"), s.alias("score"))) for c, k, m, s in rules]))


def scored(df: DataFrame, task: str, model: str = "", position: Column | None = None, compressible: Column | None = None) -> DataFrame:
    """df with structure, context, position, repetition_score, clarity and total to one decimal, tier, grade, suggestions and confirmations."""
    at = F.lit(0.0) if position is None else position
    parts = features.sub_scores(at)
    raw = parts.pop("total")
    # The parts are rounded after they were added up; the model's share comes before the bounds.
    total = sum(parts.values(), F.lit(0.0)) if model else raw
    total = F.round(F.least(F.greatest(total + adjustment(model, compressible), F.lit(0.0)), F.lit(100.0)), 1)
    df = df.withColumns({"suggestions": suggestions(F.col(task), at), "confirmations": confirmations(parts, at), "total": total, **{k: F.round(v, 1) for k, v in parts.items()}})
    return df.withColumns({"tier": features.tier(F.col("total")), "grade": features.grade(F.col("total"))})


def missing(task: Column) -> Column:
    """Array of messages on what a prompt lacks, those that would gain most first."""
    coding, building = task.isin("debug", "implement", "refactor", "test"), task.isin("implement", "test")
    rules = [
        (7, ~F.col("has_code"), "code"),
        (6, ~F.col("has_files") & coding, "files"),
        (6, ~F.col("has_errors") & (task == "debug"), "error"),
        (6, F.col("n_words") < 20, "detail"),
        (5, ~F.col("has_constraints"), "constraints"),
        (4, F.col("ambiguity") > 0.5, "names"),
        (3, ~F.col("has_io_spec"), "input and output"),
        (2, ~F.col("has_edge_cases") & building, "edge cases"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for _, c, m in rules]))


def check(df: DataFrame, text: str, model: str = "", threshold: int = THRESHOLD, max_tokens: int = 0) -> DataFrame:
    """df with all of `scored`, whether the total reaches the threshold, what is missing if not, lint rules, the rewritten text and
    the score that it gains."""
    from parlance.functions import rewriting

    keep = df.columns
    d = df.withColumn("_text", F.col(text)).withColumn("task", X.category(F.col("_text")))
    again = d.withColumn("rewritten", rewriting.rewrite("_text"))
    before = scored(features.with_features(again, "_text").withColumn("_at", features.instruction_position(features.segments("_text"))), "task", model, F.col("_at"))
    scores = ["total", "structure", "context", "position", "repetition_score", "clarity", "tier", "grade", "suggestions", "confirmations"]
    out = before.withColumns({
        "passed": F.col("total") >= threshold,
        "missing": F.when(F.col("total") >= threshold, F.array().cast("array<string>")).otherwise(missing(F.col("task"))),
        "lint": X.lint(F.col("_text"), max_tokens=max_tokens, model=model),
        "n_tokens": X.estimate_tokens(F.col("_text")),
    }).select(*keep, "task", "rewritten", *scores, "passed", "missing", "lint", "n_words", "n_tokens")
    # The second pass gives the gain only; the row keeps its own scores.
    packed = materialize(out.withColumn("_own", F.struct(*scores, "n_words")).drop(*scores, "n_words"), "checked")
    new = features.with_features(packed, "rewritten").withColumn("_at", features.instruction_position(features.segments("rewritten")))
    new = scored(new, "task", model, F.col("_at"))
    return new.select(*keep, "task", *[F.col(f"_own.{s}").alias(s) for s in scores], "passed", "missing", "lint", "rewritten", F.round(F.col("total") - F.col("_own.total"), 1).alias("rewrite_gain"), F.col("_own.n_words").alias("n_words"), "n_tokens")


def explain(task: Column, position: Column) -> dict[str, Column]:
    """strengths, weaknesses, tips (arrays) and summary of rows of `scored`, by bands of the parts."""
    says = lambda c, m: F.when(c, F.lit(m) if isinstance(m, str) else m)
    listed = lambda head, *named: F.concat(F.lit(head), F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in named])), ", "))
    clarity, context, place, structure, repeats = (F.col(c) for c in ("clarity", "context", "position", "structure", "repetition_score"))
    any_context, any_structure = F.col("has_code") | F.col("has_files") | F.col("has_errors"), F.col("has_role") | F.col("has_constraints") | F.col("has_examples")
    strengths = [
        says(clarity >= 20, "Clear language"),
        says((context >= 20) & any_context, listed("Rich context: ", ("has_code", "code"), ("has_files", "files"), ("has_errors", "errors"))),
        says((context >= 20) & ~any_context, "Good detail"),
        says(place >= 16, "The instruction stands at the start"),
        says((structure >= 12) & any_structure, listed("Well structured: ", ("has_role", "role"), ("has_constraints", "constraints"), ("has_examples", "examples"))),
        says(repeats >= 12, "Key terms are repeated"),
    ]
    weaknesses = [
        says((clarity >= 12) & (clarity < 20) & (F.col("ambiguity") > 0.3), "Some words refer to nothing"),
        says((clarity < 12) & (F.col("n_words") < 10), "Very short"),
        says((clarity < 12) & (F.col("ambiguity") > 0.5), "Highly ambiguous"),
        says(context < 10, "No files, code or errors"),
        says((place < 8) & (position > 0.4), "The instruction lies in the middle"),
        says((repeats < 12) & (F.col("repetition") > 0.3), "Too much repetition"),
    ]
    tips = [
        says((clarity >= 12) & (clarity < 20) & (F.col("ambiguity") > 0.3), "Put names in the place of pronouns"),
        says((clarity < 12) & (F.col("n_words") < 10), "Say what, where and why"),
        says((context >= 10) & (context < 20) & ~F.col("has_files"), "Name the files concerned"),
        says((context >= 10) & (context < 20) & ~F.col("has_errors") & (task == "debug"), "Give the error message as it stands"),
        says((context < 10) & (F.col("specificity") < 0.3), "Give specifics: which file, what error, what was tried"),
        says((place < 8) & (position > 0.4), "Begin with the request, then give the context"),
        says((structure < 12) & (F.col("n_words") > 15) & ~F.col("has_constraints"), "Set boundaries"),
        says((repeats < 12) & (F.col("repetition") > 0.3), "Vary the wording"),
    ]
    arrays = {k: F.array_compact(F.array(*v)) for k, v in (("strengths", strengths), ("weaknesses", weaknesses), ("tips", tips))}
    total = F.col("total")
    more = F.size(arrays["weaknesses"]) > F.size(arrays["strengths"])
    summary = (
        F.when(total >= 85, "excellent")
        .when(total >= 70, F.when(F.size(arrays["weaknesses"]) > 0, "strong, with room").otherwise("strong"))
        .when(total >= 50, "decent")
        .when(total >= 30, F.when(more, "lacks context").otherwise("basic"))
        .otherwise("minimal")
    )
    return {**arrays, "summary": summary}


def compare(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with score_a, score_b and winner (a or b; a of equal ones) of two text columns."""
    for c, to in ((a, "score_a"), (b, "score_b")):
        keep = df.columns
        d = features.with_features(df.withColumn("_text", F.col(c)), "_text").withColumn("_at", features.instruction_position(features.segments("_text")))
        total = features.sub_scores(F.col("_at"))["total"]
        df = d.select(*keep, F.round(total, 1).alias(to))
    return df.withColumn("winner", F.when(F.col("score_a") >= F.col("score_b"), "a").otherwise("b"))
