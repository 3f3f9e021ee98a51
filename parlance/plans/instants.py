"""Query p2_found: the instants of the four timestamp fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import timestamps
from parlance.session import read_table

# Table, key, field and source (an expression) of each field of problem 2.
FIELDS = [
    ("prompts", "id", "timestamp", "source"),
    ("chatgpt_conversations", "rec_id", "create_time", "'chatgpt-export'"),
    ("claude_chat_export", "rec_id", "created_at", "'claude-chat-export'"),
    ("gemini_session", "rec_id", "timestamp", "'gemini'"),
]


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id, raw, zone) of all rows of the four tables."""
    parts = [read_table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(k).alias("rec_id"), F.col(c).alias("raw"), F.expr(s).alias("source")) for t, k, c, s in FIELDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # One row per source (nine); Spark broadcasts it by its size.
    zones = read_table(spark, sf_dir, "source_zones").select("source", "zone").dropDuplicates(["source"])
    return out.join(zones, "source", "left").drop("source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(values(spark, sf_dir)).select("tbl", "rec_id", "utc_us")


def _sql() -> str:
    """The same instants in SQL: the forms' patterns, calendar checks, offsets and zone rules."""
    t = timestamps
    forms = [(f"(?i)^{date}(?:{joint}{t._TIME}{t._ZONE})?$", [*ymd, 4, 5, 6, 7, 8, 9, 10]) for _, date, joint, ymd in t.FORMS]
    forms.append((t._COMPACT, [1, 2, 3, 4, 5, 6, 7, None, 8, 9]))
    quote = lambda v: v.replace("'", "''")
    names = ["y", "mo", "d", "h", "mi", "se", "fr", "ap", "off", "region"]

    def field(k: int) -> str:
        # The tenth group, a region in brackets, lies beyond what the function extracts.
        region = r"nullif(regexp_extract(s, '\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\]$', 1), '')"
        of = lambda p, g: "NULL" if g is None else region if k == 9 else f"nullif(regexp_extract(s, '{quote(p)}', {g}), '')"
        cases = " ".join(f"WHEN m{i} THEN {of(p, groups[k])}" for i, (p, groups) in enumerate(forms))
        return f"CASE {cases} END AS {names[k]}"

    matches = ", ".join(f"regexp_matches(s, '{quote(p)}') AS m{i}" for i, (p, _) in enumerate(forms))
    fields = ", ".join(field(k) for k in range(10))
    months = "[" + ", ".join(f"'{m}'" for m in t.MONTHS) + "]"
    zones = " ".join(f"WHEN '{k}' THEN {v * 60}" for k, v in t.ABBREVIATIONS.items())
    q = r"""[\s\p{Z}"''`\x{2018}\x{2019}\x{201C}\x{201D}\x{FEFF}]+"""
    values = " UNION ALL ".join(f"SELECT '{tbl}' AS tbl, {key} AS rec_id, {c} AS raw, {src} AS source FROM {tbl}" for tbl, key, c, src in FIELDS)
    number = r"^[+]?(\d{1,25}(\.\d*)?|\.\d+)([eE][+]?\d{1,2})?$"
    units = ", ".join(
        f"CASE WHEN x >= {t.EPOCH_FROM * k}::DECIMAL(31,12) AND x < {t.EPOCH_TO * k}::DECIMAL(31,12) THEN CAST(floor({f'x::DECIMAL(38,12) * {1000000 // k}' if k <= 1000000 else f'x / {k // 1000000}'}) AS BIGINT) END" for k in (1, 1000, 1000000)
    )
    nano = f"CASE WHEN x >= {t.EPOCH_FROM * 10**9}::DECIMAL(31,12) AND x < {t.EPOCH_TO * 10**9}::DECIMAL(31,12) THEN CAST(floor(x) AS HUGEINT)::BIGINT // 1000 END"
    return f"""
WITH v AS ({values}), c AS (SELECT tbl, rec_id, zone, regexp_replace(regexp_replace(raw, '^{q}', ''), '{q}$', '') AS s FROM v LEFT JOIN source_zones USING (source) WHERE raw IS NOT NULL),
m AS (SELECT *, {matches} FROM c), f AS (SELECT tbl, rec_id, zone, s, {fields} FROM m),
g AS (SELECT *, TRY_CAST(y || '-' || CASE WHEN regexp_matches(mo, '^\\d') THEN mo ELSE list_position({months}, lower(left(mo, 3)))::VARCHAR END || '-' || d AS DATE) AS day, coalesce(h, '0')::INT AS hh,
  coalesce(mi, '0')::INT AS mm, coalesce(se, '0')::INT AS ss, rpad(left(coalesce(fr, ''), 6), 6, '0')::BIGINT AS us, h IS NULL OR mi IS NOT NULL OR ap IS NOT NULL AS whole,
  replace(regexp_replace(off, '(?i)^(UTC|GMT)([+-])', '\\2'), chr(8722), '-') AS o FROM f),
n AS (SELECT *, CASE WHEN NOT whole THEN -1 WHEN ap IS NULL THEN hh WHEN hh < 1 OR hh > 12 THEN -1 ELSE hh % 12 + CASE WHEN lower(ap) = 'p' THEN 12 ELSE 0 END END AS hour, replace(substr(o, 2), ':', '') AS dg FROM g),
l AS (SELECT *, CASE WHEN hour BETWEEN 0 AND 23 AND mm BETWEEN 0 AND 59 AND ss BETWEEN 0 AND 59 THEN epoch_us(day) + ((hour * 60 + mm) * 60 + ss)::BIGINT * 1000000 + us END AS local,
  CASE WHEN regexp_matches(o, '^[+-]\\d') THEN CASE WHEN left(dg, 2)::INT <= 18 AND coalesce(nullif(substr(dg, 3, 2), ''), '0')::INT <= 59 THEN (left(dg, 2)::INT * 3600 + coalesce(nullif(substr(dg, 3, 2), ''), '0')::INT * 60 + coalesce(nullif(substr(dg, 5, 2), ''), '0')::INT) * CASE WHEN o[1] = '-' THEN -1 ELSE 1 END END
    ELSE CASE upper(o) {zones} END END AS offset_s, (SELECT any_value(name) FROM pg_timezone_names() WHERE name = coalesce(region, zone)) AS z, TRY_CAST(CASE WHEN regexp_matches(s, '{number}') THEN s END AS DECIMAL(31,12)) AS x FROM n),
z AS (SELECT *, CASE WHEN o IS NULL AND z IS NOT NULL THEN epoch_us(timezone(z, make_timestamp(local))) END AS u FROM l),
e AS (SELECT *, CASE WHEN u IS NULL THEN NULL WHEN epoch_us(timezone(z, make_timestamptz(u))) <> local THEN local - (epoch_us(timezone(z, make_timestamptz(u - 10800000000))) - (u - 10800000000))
  WHEN epoch_us(timezone(z, make_timestamptz(u - 3600000000))) = local THEN u - 3600000000 ELSE u END AS zoned FROM z)
SELECT tbl, rec_id, coalesce(CASE WHEN o IS NOT NULL THEN local - offset_s::BIGINT * 1000000 ELSE zoned END, {units}, {nano}) AS utc_us FROM e
WHERE coalesce(CASE WHEN o IS NOT NULL THEN local - offset_s::BIGINT * 1000000 ELSE zoned END, {units}, {nano}) IS NOT NULL"""


SQL = _sql()
