"""One UTC instant for timestamps of mixed form, precision and zone.

Distinct raw strings with their zone form a dictionary; only the dictionary is parsed, and instants are joined back to the rows.
Parsing is a chain of built-in column expressions, so it stays inside the JVM.

Defined results: null, blank, wordy, incomplete or impossible values and those of unknown zones have no instant (null from `with_instant`, no row from
`normalise`); repeated rows each get their own row; an empty table gives an empty table; columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import exists, materialize, new_folder

# Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Bare numbers count from 1970 in the unit that puts them into 2023-2027.
EPOCH_FROM, EPOCH_TO = 1672531200, 1830297600

_TIME = r"(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*([A-Za-z]{1,4}|(?:(?:UTC|GMT)?[+\-\x{2212}]\d{2}(?::?\d{2})?(?::?\d{2})?))?\s*(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December)"
# Each form: the date pattern, what joins date and time, and the groups that hold year, month and day.
FORMS = [
    ("iso", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"(?:[Tt]|,?\s+)", (1, 2, 3)),
    ("us", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(?:[Tt]|,?\s+)", (3, 1, 2)),
    ("dotted", r"(\d{1,2})\.(\d{1,2})\.(\d{4})", r"(?:[Tt]|,?\s+)", (3, 2, 1)),
    ("named_month_first", r"(?:[A-Za-z]{3,9},?\s+)?" + _MONTH + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", r"(?:,?\s+(?:at\s+)?)", (3, 1, 2)),
    ("named_day_first", r"(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})(?:st|nd|rd|th)?[\s\-]+" + _MONTH + r"\.?,?[\s\-]+(\d{4})", r"(?:,?\s+(?:at\s+)?)", (3, 2, 1)),
]
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[Tt\s](\d{2})(\d{2})?(\d{2})?(?:[.,](\d+))?" + _ZONE + r")?$"


def clean(raw: Column) -> Column:
    """The value without outer blanks and quotes."""
    q = r"[\s\p{Z}\"'`\x{2018}\x{2019}\x{201C}\x{201D}\x{FEFF}]+"
    return F.regexp_replace(F.regexp_replace(raw, "(?U)^" + q, ""), "(?U)" + q + "$", "")


def _canonical(s: Column) -> Column:
    """year|month|day|hour|minute|second|fraction|a or p|zone|region of a value in one of the forms; null for others."""
    out = []
    for _, date, joint, (y, m, d) in FORMS:
        p = f"(?i)^{date}(?:{joint}{_TIME}{_ZONE})?$"
        out.append(F.when(s.rlike(p), F.regexp_replace(s, p, f"${y}|${m}|${d}|$4|$5|$6|$7|$8|$9|$10")))
    out.append(F.when(s.rlike(_COMPACT), F.regexp_replace(s, _COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8|$9")))
    return F.coalesce(*out)


def with_instant(df: DataFrame, raw: str = "raw", zone: str = "zone", to: str = "utc_us") -> DataFrame:
    """df with the column `to`: microseconds since 1970-01-01 UTC of column raw (BIGINT), or null.

    Column zone holds the IANA zone of values that name none; where it is null those have no instant. The steps are separate
    projections, so that no pattern is evaluated twice.
    """
    keep = [c for c in df.columns if c != to]
    df = df.withColumn("_s", clean(F.col(raw)))
    df = df.withColumn("_f", F.split(_canonical(F.col("_s")), r"\|"))
    part = lambda k: F.nullif(F.get(F.col("_f"), F.lit(k)), F.lit(""))
    zero = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    months = F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS) for x in (n, i + 1)])
    mo = F.when(part(1).rlike(r"^\d"), part(1).cast("int")).otherwise(months[F.substring(F.lower(part(1)), 1, 3)])
    # A time without minutes counts only with am or pm.
    whole = part(3).isNull() | part(4).isNotNull() | part(7).isNotNull()
    ap, hour = part(7), zero(part(3))
    hour = F.when(ap.isNull(), hour).when((hour < 1) | (hour > 12), F.lit(-1)).otherwise(hour % 12 + F.when(F.lower(ap) == "p", 12).otherwise(0))
    df = df.withColumn("_day", F.unix_micros(F.try_make_timestamp(part(0).cast("int"), mo, part(2).cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))))
    df = df.withColumn("_hour", F.when(whole, hour))
    fits = F.col("_hour").between(0, 23) & zero(part(4)).between(0, 59) & zero(part(5)).between(0, 59)
    micro = F.rpad(F.substring(F.coalesce(part(6), F.lit("")), 1, 6), 6, "0").cast("long")
    df = df.withColumn("_local", F.when(fits, F.col("_day") + ((F.col("_hour") * 60 + zero(part(4))) * 60 + zero(part(5))).cast("long") * 1000000 + micro))
    off = F.regexp_replace(F.regexp_replace(part(8), "(?i)^(UTC|GMT)(?=.)", ""), "\\x{2212}", "-")
    df = df.withColumn("_off", off).withColumn("_digits", F.regexp_replace(F.substring("_off", 2, 10), ":", ""))
    two = lambda a: F.when(F.length("_digits") > a, F.substring("_digits", a, 2).cast("int")).otherwise(0)
    signed = F.when((two(1) <= 18) & (two(3) <= 59), (two(1) * 3600 + two(3) * 60 + two(5)) * F.when(F.col("_off").startswith("-"), -1).otherwise(1))
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in (kv[0], kv[1] * 60)])[F.upper("_off")]
    df = df.withColumn("_offset", F.when(F.col("_off").rlike(r"^[+-]\d"), signed).when(F.col("_off").isNotNull(), named))
    # to_utc_timestamp takes the earlier instant of a doubled local time and the offset before the change of a skipped one.
    # A zone that Java does not know would end the query; it gives no instant.
    region = F.coalesce(part(9), F.col(zone))
    region = F.when(region.isin(sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())), region)
    utc = F.when(F.col("_off").isNotNull(), F.col("_local") - F.col("_offset").cast("long") * 1000000).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), region)))
    df = df.withColumn("_x", F.when(F.col("_s").rlike(r"^[+]?(\d{1,25}(\.\d*)?|\.\d+)([eE][+]?\d{1,2})?$"), F.col("_s")).try_cast("decimal(31,12)"))
    x, numbers = F.col("_x"), []
    for scale in (1, 1000, 1000000, 1000000000):
        lo, hi = (F.lit(v * scale).cast("decimal(31,12)") for v in (EPOCH_FROM, EPOCH_TO))
        # Exact: the unit's factor to microseconds is a power of ten either way.
        micros = F.floor(x * F.lit(1000000 // scale).cast("decimal(7,0)")) if scale <= 1000000 else F.floor(x / F.lit(scale // 1000000).cast("decimal(4,0)"))
        numbers.append(F.when((x >= lo) & (x < hi), micros.cast("long")))
    return df.select(*keep, F.coalesce(utc, *numbers).alias(to))


def dictionary(values: DataFrame, path: str | None = None) -> DataFrame:
    """(raw, zone, n, utc_us) of the distinct pairs raw and zone of values, n their rows.

    Instants are persisted at path (a new folder if none is given), which grows: pairs that are already there are not parsed again.
    """
    spark = values.sparkSession
    # The dictionary is grouped before parsing: a hot value is pre-aggregated where it is read.
    counts = values.filter(F.col("raw").isNotNull()).groupBy("raw", "zone").agg(F.count(F.lit(1)).alias("n"))
    if path is None or not exists(spark, path):
        path = path or new_folder(spark, "instants")
        with_instant(counts).write.parquet(path)
        return spark.read.parquet(path)
    counts = materialize(counts, "values")
    known = spark.read.parquet(path).select("raw", "zone", "utc_us")
    new = _join(counts, known.select("raw", "zone"), "left_anti")
    with_instant(new).write.mode("append").parquet(path)
    return _join(counts, spark.read.parquet(path).select("raw", "zone", "utc_us"))


#: A dictionary entry that holds at least 1/HOT of all rows is joined by broadcast: there are at most HOT such entries.
HOT = 1000


def normalise(values: DataFrame, path: str | None = None) -> DataFrame:
    """Each row of values (raw, zone and other columns) whose raw names an instant, with utc_us.

    The dictionary is persisted; entries that hold a thousandth of all rows or more (at most a thousand, whatever the size) are
    joined by broadcast, so no hot value reaches one task; the rest are joined by key.
    """
    d = dictionary(values, path)
    total = d.agg(F.sum("n")).first()[0] or 0
    least = max(-(-total // HOT), 1)
    hot = d.filter(F.col("n") >= least).select("raw", "zone", "utc_us", F.lit(True).alias("_hot"))
    marked = _join(values.filter(F.col("raw").isNotNull()), F.broadcast(hot), "left")
    cold = marked.filter(F.col("_hot").isNull()).drop("utc_us", "_hot")
    rest = d.filter((F.col("n") < least) & F.col("utc_us").isNotNull()).select("raw", "zone", "utc_us")
    return marked.filter(F.col("_hot") & F.col("utc_us").isNotNull()).drop("_hot").unionByName(_join(cold, rest))


def _join(rows: DataFrame, d: DataFrame, how: str = "inner") -> DataFrame:
    d = d.select(F.col("raw").alias("_raw"), F.coalesce("zone", F.lit("")).alias("_zone"), *[c for c in d.columns if c not in ("raw", "zone")])
    on = (F.col("raw") == F.col("_raw")) & (F.coalesce("zone", F.lit("")) == F.col("_zone"))
    return rows.join(d, on, how).drop("_raw", "_zone")
