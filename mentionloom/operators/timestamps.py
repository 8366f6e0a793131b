"""Timestamps of mixed formats and zones as one instant in UTC.

Values are parsed to local wall-clock microseconds (an Arrow-batched parser: some thirty formats in six
languages), then joined as-of to zone-offset intervals. The intervals of a zone are exploded by year of local
time, so the range join becomes an equi-join on (zone, year) with a handful of intervals beside each value: two
matching intervals mean an ambiguous time, none a skipped one, one gives the offset.

Every year is covered: before FIRST_YEAR a zone keeps its first offset (no zone changed earlier), and after LAST_YEAR
its rules repeat with the calendar, every 400 years, so such a year is looked up that many years earlier.

Defined results: null, empty, relative and impossible values, and instants after the year 9999, are unreadable and give
no row; an unknown zone counts as UTC; repeated rows give one row; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Years of the table of zone intervals: all changes on record, and a whole cycle of the calendar under the last rules.
FIRST_YEAR, LAST_YEAR = 1800, 2499
_CYCLE, _CYCLE_US = 400, 146_097 * 86_400_000_000
#: From this year on a zone only follows its last rules.
_SETTLED = 2100
_LAST_US = 253_402_300_800_000_000
_LONG_AGO = 100_000 * 366 * 86_400

#: Month names by language; a value is matched by its first three or four letters where that is unique.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
EXTRA_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12, "mär": 3, "okt": 10, "dez": 12, "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12, "maerz": 3, "fev": 2, "aout": 8}
MONTH = {w: i + 1 for names in MONTHS.values() for i, w in enumerate(names.split())} | EXTRA_MONTHS

_TIME = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{2}:?\d{2}|(?:UTC|GMT)(?:[+-]\d{1,2}(?::?\d{2})?)?|[A-Z]{2,5}))?"
_TAIL = rf"(?:(?:T|,?\s+(?:à\s+|um\s+|at\s+|a las\s+)?){_TIME}\s*(?P<ap>[AaPp]\.?[Mm]\.?)?(?:\s*Uhr)?{_ZONE})?$"
_FORMS = [re.compile(p + _TAIL) for p in (
    r"^(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})",
    r"^(?P<y>\d{4})年(?P<m>\d{1,2})月(?P<d>\d{1,2})日",
    r"^(?P<a>\d{1,2})[-/.](?P<b>\d{1,2})[-/.](?P<y>\d{4}|\d{2})",
    r"^(?:\w{2,12}\.?,?\s+)?(?P<d>\d{1,2})(?:\.|st|nd|rd|th)?\s+(?:de\s+)?(?P<mon>[^\W\d_]{3,12})\.?,?\s+(?:de\s+)?(?P<y>\d{4})(?:\s*г\.?)?",
    r"^(?:\w{2,12}\.?,\s+)?(?P<mon>[^\W\d_]{3,12})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})",
)]
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?$")
_DAY_US, _EPOCH = 86_400_000_000, date(1970, 1, 1).toordinal()


def _local_us(y: int, m: int, d: int, h: int, mi: int, s: int, frac: str | None) -> int:
    days = date(y, m, d).toordinal() - _EPOCH
    if h > 23 or mi > 59 or s > 59:
        raise ValueError
    return days * _DAY_US + ((h * 60 + mi) * 60 + s) * 1_000_000 + int((frac or "0")[:6].ljust(6, "0"))


def parse_timestamp(value: str | None, date_order: str | None = None) -> tuple[int, int | None, str | None] | None:
    """(local microseconds, stated offset in microseconds or None, zone letters or None), or None if unreadable."""
    v = " ".join((value or "").split())
    if not v:
        return None
    try:
        if re.fullmatch(r"\d{1,19}", v):
            us = int(v) * (1_000_000 if len(v) <= 11 else 1000)
            return (us, 0, None) if us < _LAST_US else None
        if m := _COMPACT.match(v):
            y, mo, d, h, mi, s, f, z = m.groups()
            return (_local_us(int(y), int(mo), int(d), int(h), int(mi), int(s or 0), f), *_zone(z))
        for form in _FORMS:
            if m := form.match(v):
                g = m.groupdict()
                if g.get("a"):
                    one, two, third = int(g["a"]), int(g["b"]), g["y"]
                    if date_order == "YMD" and len(third) == 2:
                        y, mo, d = 2000 + one, two, int(third)
                    else:
                        y = int(third) if len(third) == 4 else 2000 + int(third)
                        d, mo = (two, one) if date_order == "MDY" else (one, two)
                else:
                    y, d = int(g["y"]), int(g["d"])
                    mo = int(g["m"]) if g.get("m") else MONTH[g["mon"].lower()]
                h = int(g["h"] or 0)
                if g["ap"]:
                    if h > 12:
                        return None
                    h = h % 12 + (12 if g["ap"][0] in "pP" else 0)
                return (_local_us(y, mo, d, h, int(g["mi"] or 0), int(g["s"] or 0), g["f"]), *_zone(g["z"]))
    except (ValueError, KeyError, OverflowError):
        pass
    return None


def _zone(z: str | None) -> tuple[int | None, str | None]:
    if not z:
        return None, None
    if z in ("Z", "UTC", "GMT", "UT"):
        return 0, None
    if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", z):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        if minutes > 18 * 60:
            raise ValueError
        return (-1 if m[1] == "-" else 1) * minutes * 60_000_000, None
    return None, z


def zone_intervals(zone: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple[int, int, int, str]]:
    """(first UTC second, end UTC second, offset in seconds, letters) of each offset interval; transitions by bisection."""
    tz, settled = ZoneInfo(zone), int(datetime(_SETTLED, 1, 1, tzinfo=timezone.utc).timestamp())
    lo = int(datetime(first, 1, 1, tzinfo=timezone.utc).timestamp()) - 2 * 86400
    hi = int(datetime(last, 12, 31, tzinfo=timezone.utc).timestamp())

    def at(t: int) -> tuple[int, str]:
        x = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(tz)
        return int(x.utcoffset().total_seconds()), x.tzname() or ""

    out, begin, now, t = [], lo, at(lo), lo
    while t < hi:
        u = min(t + (14 if t < settled else 28) * 86400, hi)
        if (new := at(u)) != now:
            a, b = t, u
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if at(mid) == now else (a, mid)
            out.append((begin, b, *now))
            begin, now, t = b, at(b), b
            continue
        t = u
    return [*out, (begin, hi, *now)]


def _intervals_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for zone in pdf["tz"]:
            try:
                found = zone_intervals(zone)
            except Exception:  # not an IANA name
                continue
            for n, (b, e, off, letters) in enumerate(found):
                start, end = (b if n else -_LONG_AGO) + off, e + off
                # a day on either side: the interval before a skipped hour must be at hand
                y0, y1 = ((datetime(1970, 1, 1) + timedelta(seconds=x)).year for x in (max(start, found[0][0]) - 86400, end + 86400))
                rows += [(zone, y, start * 1_000_000, end * 1_000_000, off * 1_000_000, letters) for y in range(y0, y1 + 1)]
        yield pd.DataFrame(rows, columns=["tz", "tz_year", "lo", "hi", "off", "letters"])


def offset_table(zones: DataFrame) -> DataFrame:
    """One row per (tz, tz_year) with its intervals: at most some 600 zones by 700 years, whatever the data."""
    rows = zones.select("tz").where("tz IS NOT NULL").distinct().mapInPandas(
        _intervals_of, "tz string, tz_year int, lo long, hi long, off long, letters string")
    return rows.groupBy("tz", "tz_year").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "off", "letters"))).alias("iv"))


_PARSED = T.StructType([T.StructField("local_us", T.LongType()), T.StructField("off_us", T.LongType()), T.StructField("letters", T.StringType())])


@F.pandas_udf(_PARSED)
def _parsed(value: pd.Series, order: pd.Series) -> pd.DataFrame:
    found = [parse_timestamp(v, o) or (None, None, None) for v, o in zip(value, order)]
    return pd.DataFrame({
        "local_us": pd.array([x[0] for x in found], "Int64"), "off_us": pd.array([x[1] for x in found], "Int64"),
        "letters": pd.Series([x[2] for x in found], dtype=object)})


def resolve(df: DataFrame, offsets: DataFrame, local_us: Column, tz: Column, letters: Column | None = None) -> DataFrame:
    """Adds ``offset_us`` and ``n_matches`` (2 ambiguous, 0 skipped) by the as-of join to zone intervals."""
    # the year by the calendar alone, whatever the session's own zone
    year = F.year(F.date_from_unix_date(((local_us - F.pmod(local_us, F.lit(_DAY_US))) / _DAY_US).cast("int")))
    back = F.greatest(F.lit(0), F.ceil((year - LAST_YEAR) / _CYCLE)).cast("long")
    keyed = df.withColumn("_l", local_us - back * _CYCLE_US).withColumn("_tz", tz)
    keyed = keyed.withColumn("_y", F.greatest(F.lit(FIRST_YEAR), year - back * _CYCLE).cast("int"))
    keyed = keyed.withColumn("_z", letters if letters is not None else F.lit(None).cast("string"))
    # Bounded by zones times years whatever the data, so it is broadcast.
    o = offsets.select(F.col("tz").alias("_tz"), F.col("tz_year").alias("_y"), "iv")
    j = keyed.join(F.broadcast(o), ["_tz", "_y"], "left")
    match = F.filter("iv", lambda x: (x["lo"] <= F.col("_l")) & (F.col("_l") < x["hi"]))
    named = F.filter("iv", lambda x: x["letters"] == F.col("_z"))
    before = F.filter("iv", lambda x: x["hi"] <= F.col("_l"))
    offset = (
        F.when(F.size(named) > 0, F.coalesce(
            F.get(F.filter(match, lambda x: x["letters"] == F.col("_z")), F.lit(0))["off"], F.get(named, F.lit(0))["off"]))
        .when(F.size(match) > 0, F.array_max(F.transform(match, lambda x: x["off"])))
        .when(F.size(before) > 0, F.element_at(before, -1)["off"])
    )
    return j.withColumn("offset_us", offset).withColumn("n_matches", F.greatest(F.size(match), F.lit(0))).drop("_l", "_tz", "_y", "_z", "iv")


def normalize_timestamps(records: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("date_publish", "date_download", "date_modify"),
                         utc_fields: tuple[str, ...] = ("date_download",), key: str = "article_id", source: str = "source_domain") -> DataFrame:
    """(key, field, utc_us): one row per readable value. ``sources`` is a small dimension table (source_domain,
    time_zone, date_order); Spark broadcasts it by its own size check."""
    site = sources.groupBy(F.col("source_domain").alias("_s")).agg(F.first("time_zone").alias("tz"), F.first("date_order").alias("date_order"))
    long = records.select(F.col(key), F.col(source).alias("_s"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select(key, "_s", "x.*")
    long = long.where(F.length(F.trim("value")) > 0).join(site, "_s", "left")
    parsed = long.withColumn("p", _parsed("value", "date_order")).where("p.local_us IS NOT NULL")
    parsed = parsed.select(key, "field", "tz", "p.*")
    zone = F.when(F.col("field").isin(*utc_fields) & F.col("letters").isNull(), F.lit("UTC")).otherwise(F.coalesce("tz", F.lit("UTC")))
    at = resolve(parsed.withColumn("_zone", zone), offset_table(site.select("tz").union(
        site.sparkSession.createDataFrame([("UTC",)], "tz string"))), F.col("local_us"), F.col("_zone"), F.col("letters"))
    utc = F.col("local_us") - F.coalesce("off_us", "offset_us", F.lit(0))
    return at.select(key, "field", utc.alias("utc_us")).distinct()
