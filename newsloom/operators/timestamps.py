"""Normalise timestamps written in many formats and zones to one UTC instant.

Every known way of writing a moment is one branch of a single regular expression with named groups. One
`regexp_replace` per value turns the text into the list of its components (an unmatched text gives none); the
components are checked against the calendar and the instant is assembled from day numbers in 64-bit integers. All of
it stays in generated JVM code.

Rules: missing smaller units are zero; digits below the microsecond are dropped; a date alone is its local midnight.
An offset or zone in the text wins over the row's own zone; an abbreviation is looked up in the row's own zone first.
A repeated local hour means its first occurrence; a skipped one is read with the offset before the change.

Null, empty, relative ("2 hours ago"), placeholder and impossible texts give null, never an error; so does a text
without a zone in a row without a usable zone. Ties and repeated rows are independent of each other.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names, January to December, as feeds write them. English ones are also known by three letters.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "hi": "जनवरी फ़रवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर",
    "ar": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "th": "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม",
}
# Offsets in minutes of abbreviations that mean the same everywhere.
UNIVERSAL = {"z": 0, "utc": 0, "ut": 0, "gmt": 0}
# Zones asked in turn for an abbreviation that the row's own zone doesn't use.
FALLBACK_ZONES = (
    "America/New_York America/Chicago America/Denver America/Los_Angeles Europe/London Europe/Berlin Europe/Athens "
    "Europe/Moscow Asia/Kolkata Asia/Shanghai Asia/Tokyo Australia/Sydney"
).split()

_NAME = r"[\p{L}\p{M}]+\.?"
_ZONE = r"(?:\s*(?<o@>[+-]\d{2}(?::?\d{2})?)|\s*(?<z@>[a-z]{1,5})(?![a-z/_]))?(?:\s*\[?(?<r@>[a-z]+(?:/[a-z0-9_+-]+)+)\]?)?"
_CLOCK = r"(?<h@>\d{1,2}):(?<i@>\d{2})(?::(?<s@>\d{2})(?:[.,](?<f@>\d+))?)?(?:\s*(?<p@>[ap])\.?\s?m\.?(?![a-z]))?"
# The formats, each a branch of the alternation; @ is replaced by the branch's number.
FORMATS = (
    rf"(?<y@>\d{{4}})[-/.](?<m@>\d{{1,2}})[-/.](?<d@>\d{{1,2}})(?:(?:t|,?\s+){_CLOCK}{_ZONE})?",  # 2025-09-01T18:43:56.184+0200[Zone]
    r"(?<y@>\d{4})(?<m@>\d{2})(?<d@>\d{2})(?:t?(?<h@>\d{2})(?<i@>\d{2})(?<s@>\d{2})(?:[.,](?<f@>\d+))?(?:(?<o@>[+-]\d{2}(?::?\d{2})?)|(?<z@>[a-z]{1,5}))?)?",  # 20250901T191117Z
    rf"(?:{_NAME},?\s+)?(?<d@>\d{{1,2}})\.?(?:\s+de)?[\s-]+(?<n@>{_NAME})(?:\s+de)?[\s-]+(?<y@>\d{{4}}|\d{{2}})(?:\s*г\.?)?(?:,?\s+(?:à\s+|um\s+)?{_CLOCK}(?:\s*uhr)?{_ZONE})?",  # Mon, 1 Sep 2025 19:23:55 BST
    rf"{_NAME},?\s+(?<n@>{_NAME})\s+(?<d@>\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(?<y@>\d{{4}})",  # Wed Sep 10 00:10:03 2025
    rf"(?:{_NAME},?\s+)?(?<n@>{_NAME})\s+(?<d@>\d{{1,2}}),?\s+(?<y@>\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_ZONE})?",  # September 1, 2025 6:07 AM
    rf"(?<a@>\d{{1,2}})(?:/|\.|-)(?<b@>\d{{1,2}})(?:/|\.|-)(?<y@>\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?",  # 08/31/2025 20:14
    rf"(?<y@>\d{{4}})\s*[年년]\s*(?<m@>\d{{1,2}})\s*[月월]\s*(?<d@>\d{{1,2}})\s*[日일](?:\s*(?:(?<h@>\d{{1,2}})\s*[時时시点點]\s*(?:(?<i@>\d{{1,2}})\s*[分분](?:\s*(?<s@>\d{{1,2}})\s*[秒초])?)?|(?<j@>\d{{1,2}}):(?<k@>\d{{2}})(?::(?<t@>\d{{2}}))?){_ZONE})?",  # 2025年9月5日4時42分
    r"(?<e@>-?\d{9,10}|-?\d{11,13})(?:\.\d*)?",  # 1756762615, 1756703883540
)
_FIELDS = "ymdabnhisfpozrejkt"
_SEP = "\u0001"


@lru_cache
def pattern() -> str:
    branches = [f.replace("@", str(k)) for k, f in enumerate(FORMATS)]
    return r"(?iu)^\s*(?:" + "|".join(branches) + r")\s*$"


@lru_cache
def _template() -> str:
    """The components in the order of _FIELDS; only one branch matched, so the same field of all branches is joined."""
    return _SEP + _SEP.join("".join(f"${{{c}{k}}}" for k, f in enumerate(FORMATS) if f"<{c}@>" in f) for c in _FIELDS) + _SEP


@lru_cache
def _zone_rules() -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, minutes) for every zone of the tz database, as in use from 2000 on."""
    rows: set[tuple[str, str, int]] = set()
    days = [datetime(y, m, 1, tzinfo=timezone.utc) for y in range(2000, 2031, 2) for m in (1, 4, 7, 10)]
    days += [d + timedelta(days=14) for d in days]
    for zone in sorted(available_timezones()):
        if "/" not in zone:
            continue
        latest: dict[str, int] = {}
        for day in sorted(days):
            local = day.astimezone(ZoneInfo(zone))
            name = (local.tzname() or "").lower()
            if name.isalpha():
                latest[name] = int(local.utcoffset().total_seconds() // 60)
        rows |= {(zone, name, minutes) for name, minutes in latest.items()}
    return tuple(sorted(rows))


def zone_abbreviations(spark: SparkSession) -> DataFrame:
    """(zone, abbreviation, minutes): a few thousand rows, bounded by the tz database."""
    return spark.createDataFrame(list(_zone_rules()), "__ts_zone string, __ts_abbr string, __ts_abbr_min int")


def _fallback_minutes(abbr: Column) -> Column:
    rules = {(z, a): m for z, a, m in _zone_rules()}
    known: dict[str, int] = {}
    for zone in FALLBACK_ZONES:
        for (z, a), m in rules.items():
            if z == zone:
                known.setdefault(a, m)
    pairs = [F.lit(x) for a, m in sorted(known.items()) for x in (a, m)]
    return F.create_map(*pairs)[abbr]


def _month_of(name: Column) -> Column:
    pairs: dict[str, int] = {}
    for language, names in MONTHS.items():
        for k, word in enumerate(names.split(), 1):
            pairs.setdefault(word, k)
            if language == "en":
                pairs.setdefault(word[:3], k)
    pairs["sept"] = 9
    pairs["फरवरी"] = 2
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])[F.rtrim(F.lower(name), F.lit("."))]


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic."""
    y1 = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y1 / 400)
    yoe = y1 - era * 400
    doy = F.floor((F.when(m > 2, m - 3).otherwise(m + 9) * 153 + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def normalise_instants(df: DataFrame, text: str, zone: str, order: str, out: str = "published_us") -> DataFrame:
    """`df` with `out`: microseconds since 1970-01-01 UTC of the moment `text` states, else null.

    `zone` names the column with the row's IANA zone, `order` the one with `dmy` or `mdy` (null: `dmy`).
    All columns of `df` stay; helper columns are named with a `__ts_` prefix and dropped.
    """
    spark = df.sparkSession
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    digits = F.translate(F.col(f"`{text}`"), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９", "0123456789" * 4)
    plain = F.regexp_replace(digits, "[\\u00a0\\u2007\\u2009\\u202f\\u3000\\ufeff\\u200b-\\u200f]", " ")
    raw = df.withColumn("__ts_all", F.split(F.regexp_replace(plain, pattern(), _template()), _SEP))
    part = lambda c: F.nullif(F.get("__ts_all", F.lit(_FIELDS.index(c) + 1)), F.lit(""))
    num = lambda c: part(c).try_cast("long")
    first_is_month = F.lower(F.trim(F.col(f"`{order}`"))) == "mdy"
    a, b = num("a"), num("b")
    year = num("y")
    parsed = raw.select(
        *keep,
        (F.size("__ts_all") == len(_FIELDS) + 2).alias("__ts_ok"),
        F.when((year < 69) & (F.length(part("y")) == 2), year + 2000).when((year < 100) & (F.length(part("y")) == 2), year + 1900).otherwise(year).alias("__ts_y"),
        F.coalesce(num("m"), _month_of(part("n")).cast("long"), F.when(first_is_month, a).otherwise(b)).alias("__ts_m"),
        F.coalesce(num("d"), F.when(first_is_month, b).otherwise(a)).alias("__ts_d"),
        F.coalesce(num("h"), num("j"), F.lit(0).cast("long")).alias("__ts_h"),
        F.coalesce(num("i"), num("k"), F.lit(0).cast("long")).alias("__ts_i"),
        F.coalesce(num("s"), num("t"), F.lit(0).cast("long")).alias("__ts_s"),
        F.coalesce(F.rpad(F.substring(part("f"), 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long")).alias("__ts_f"),
        F.lower(part("p")).alias("__ts_p"),
        part("o").alias("__ts_o"),
        F.lower(part("z")).alias("__ts_z"),
        part("r").alias("__ts_r"),
        num("e").alias("__ts_e"),
        F.length(F.regexp_replace(part("e"), "-", "")).alias("__ts_elen"),
        F.trim(F.col(f"`{zone}`")).alias("__ts_own"),
    )
    c = lambda n: F.col(f"__ts_{n}")
    hour = F.when(c("p").isNull(), c("h")).when(c("p") == "p", F.when(c("h") == 12, 12).otherwise(c("h") + 12)).otherwise(F.when(c("h") == 12, 0).otherwise(c("h")))
    valid = (
        c("y").between(1, 9999) & c("m").between(1, 12) & (c("d") >= 1) & (c("d") <= days_in_month(c("y"), c("m")))
        & c("h").between(0, 23) & c("i").between(0, 59) & c("s").between(0, 59) & (c("p").isNull() | c("h").between(1, 12))
    )
    local = (days_from_civil(c("y"), c("m"), c("d")) * 86400 + hour * 3600 + c("i") * 60 + c("s")).cast("long") * 1_000_000 + c("f")
    sign = F.when(c("o").startswith("-"), -1).otherwise(1)
    off_digits = F.rpad(F.regexp_replace(c("o"), "[^0-9]", ""), 4, "0")
    off = sign * (F.substring(off_digits, 1, 2).try_cast("long") * 60 + F.substring(off_digits, 3, 2).try_cast("long"))
    universal = F.create_map(*[F.lit(x) for p in UNIVERSAL.items() for x in p])[c("z")]
    abbr = F.coalesce(universal, F.col("__ts_abbr_min"), _fallback_minutes(c("z")))
    known = [z for z in available_timezones() if "/" in z or z == "UTC"]
    region = F.coalesce(c("r"), c("own"))
    in_zone = F.when(region.isin(known), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("local")), region)))
    located = parsed.withColumn("__ts_local", F.when(c("ok") & valid, local)).join(
        F.broadcast(zone_abbreviations(spark)), (c("own") == F.col("__ts_zone")) & (c("z") == F.col("__ts_abbr")), "left"
    )
    instant = (
        F.when(~c("ok"), None)
        .when(c("e").isNotNull(), F.when(c("elen") <= 10, c("e") * 1_000_000).otherwise(c("e") * 1_000))
        .when(c("local").isNull(), None)
        .when(c("o").isNotNull(), c("local") - off * 60_000_000)
        .when(c("z").isNotNull(), c("local") - abbr.cast("long") * 60_000_000)
        .otherwise(in_zone)
    )
    return located.select(*keep, instant.cast("long").alias(out))
