"""Prompt templates with `{name}` variables: names, variables and rendering. Built-in expressions; null templates stay null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VARIABLE = r"\{([A-Za-z_]\w*)\}"


def variables(template: Column) -> Column:
    """The distinct variables in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1)))


def render(template: Column, values: Mapping[str, Column]) -> Column:
    """The template with the values that are not null put in; other variables stay as they are."""
    for name, value in values.items():
        filled = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
        template = F.when(value.isNull(), template).otherwise(filled)
    return template


def slug(text: Column, words: int = 4) -> Column:
    """The first words in lower case, joined by dashes; `template` if there are none."""
    found = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1)), 1, words)
    return F.coalesce(F.nullif(F.array_join(found, "-"), F.lit("")), F.lit("template"))


def named(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """df with a name per row: the slug, and from the second row of a slug on its number."""
    n = F.row_number().over(Window.partitionBy("_slug").orderBy(*order))
    d = df.withColumn("_slug", slug(F.col(text))).withColumn("_n", n)
    return d.withColumn("name", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col("_n").cast("string")))).drop("_slug", "_n")


def used(store: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """The store (key, n_used) after the uses (rows of key), each adding one."""
    n = uses.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return store.join(n, key, "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")
