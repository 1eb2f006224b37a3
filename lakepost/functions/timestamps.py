"""Mixed timestamp notations to UTC instants.

Values become character-class shape masks (a digit 9, a run of letters A); each distinct mask
is mapped once to the parsers that fit its shape, and they convert all values of the mask at once
with arrays; values that the first parser leaves are given to the next, so the order of rows plays no
part.  Wall times go through zone transition tables, built per zone from the installed time
zone database, whose version is part of the table's key: a worker with another version than the
driver's raises an error.  Times beyond the tables (1850 to 2100) are read one by one.

Defined cases: null, empty and meaningless values give null; a wall time that occurs twice is
the earlier instant; one that never occurs moves forward by the gap; smaller fractions than
microseconds are cut off; missing seconds are 0; an unknown store zone leaves values without
zone information null; an offset in the value wins over a zone name in brackets after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Offsets in minutes of zone abbreviations in mail headers.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Month names and abbreviations, by their first letters.
MONTHS = {
    1: "jan sty ene led янв січ gen janv januar", 2: "feb lut fév fev úno únor febr лют фев", 3: "mar mär mrt bře mars märz maa бер", 4: "apr kwi avr abr dub кві апр",
    5: "may maj mai mei mag kvě тра мая май", 6: "jun cze juin giu čvn чер июн", 7: "jul lip juil lug čvc лип июл", 8: "aug sie aoû ago srp сер авг",
    9: "sep wrz set zář вер сен sept", 10: "oct paź okt ott out říj жов окт paz", 11: "nov lis lis листопад ноя", 12: "dec gru déc dez dic pro гру дек",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}
STANDARD = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
US = 1_000_000
FILETIME_EPOCH_US = 11_644_473_600 * US

_ZONE = r"(?P<zone>Z|(?:UTC|GMT)?\s?[+-]\d{1,2}:?(?:\d\d)?|[A-Za-z]+/[A-Za-z_/+-]+|\[[A-Za-z_/+-]+\]|[A-Z]{1,5})?\s*(?:\([A-Za-z ]+\)|\[[A-Za-z_/+-]+\])?"
_CLOCK = r"(?P<H>\d{1,2})[:.](?P<M>\d\d)(?:[:.](?P<S>\d\d)(?:[.,](?P<frac>\d+))?)?"
_AMPM = r"(?:[\s  ]*(?P<ampm>[AaPp])\.?[Mm]\.?)?"
# Each parser's pattern; a value takes the first that it matches in full.
PARSERS: list[tuple[str, re.Pattern]] = [
    ("date", re.compile(rf"(?P<Y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})[T\s]+{_CLOCK}\s*{_ZONE}")),
    ("date", re.compile(rf"(?P<Y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)T?(?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d)(?:[.,](?P<frac>\d+))?{_ZONE}")),
    ("date", re.compile(rf"(?:[^\W\d]+\.?,?\s+)?(?P<d>\d{{1,2}})[\s-]+(?P<mon>[^\W\d]+)\.?[\s-]+(?P<Y>\d{{2,4}}),?\s+{_CLOCK}{_AMPM}\s*{_ZONE}")),
    ("date", re.compile(rf"(?:[^\W\d]+\.?,\s+)?(?P<mon>[^\W\d]+)\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<Y>\d{{4}}),?\s+{_CLOCK}{_AMPM}\s*{_ZONE}")),
    ("date", re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<Y>\d{{4}}|\d\d),?[T\s]+{_CLOCK}{_AMPM}\s*{_ZONE}")),
    ("epoch", re.compile(r"/Date\((?P<ms>-?\d+)(?:[+-]\d{4})?\)/")),
    ("epoch", re.compile(r"(?P<n>\d{9,10})")),
    ("epoch", re.compile(r"(?P<ms>\d{12,13})")),
    ("epoch", re.compile(r"(?P<us>\d{15,16})")),
    ("epoch", re.compile(r"(?P<ft>\d{18})")),
]


def mask(value: str) -> str:
    """Shape mask: digits as 9, each run of letters as A, the rest as it is."""
    return re.sub(r"[^\W\d_]+", "A", re.sub(r"\d", "9", value))


@lru_cache(maxsize=1)
def database_version() -> str:
    try:
        with open("/usr/share/zoneinfo/tzdata.zi", encoding="ascii") as f:
            return f.readline().strip("# \n")
    except OSError:
        try:
            import tzdata

            return tzdata.IANA_VERSION
        except ImportError:
            return "unknown"


#: What the transition tables cover: 1850 to 2100.
FIRST_US, LAST_US = -3_786_825_600 * US, 4_102_444_800 * US


@lru_cache(maxsize=1024)
def transitions(zone: str, version: str = "") -> tuple[np.ndarray, np.ndarray] | None:
    """UTC instants (us) at which the offset (us) changes, first entry from minus infinity; null if unknown."""
    try:
        tz = ZoneInfo(zone)
    except Exception:
        return None
    offset = lambda t: int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(tz).utcoffset().total_seconds())
    step, t = 7 * 86400, FIRST_US // US
    at, offs = [np.iinfo(np.int64).min], [offset(t) * US]
    while t < LAST_US // US:
        if offset(t + step) != offset(t):
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == offset(lo) else (lo, mid)
            at.append(hi * US)
            offs.append(offset(hi) * US)
        t += step
    return np.array(at, np.int64), np.array(offs, np.int64)


def _offset_of_wall(wall: int, zone: str) -> int:
    """Offset (us) of one wall time: the earlier one where it occurs twice, that before the gap where it never does."""
    local = datetime(1970, 1, 1) + timedelta(microseconds=wall)
    return int(local.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds()) * US


def wall_to_utc(wall: np.ndarray, zone: str, version: str = "") -> tuple[np.ndarray, bool]:
    """UTC us of wall-clock us: in an overlap the earlier instant, in a gap moved forward by its length."""
    table = transitions(zone, version)
    if table is None:
        return wall, False
    at, off = table
    beyond = (wall < FIRST_US + 86400 * US) | (wall > LAST_US - 86400 * US)
    if beyond.any():
        out = wall.copy()
        out[~beyond] = wall_to_utc(wall[~beyond], zone, version)[0]
        out[beyond] = [w - _offset_of_wall(int(w), zone) for w in wall[beyond]]
        return out, True
    if len(at) == 1:
        return wall - off[0], True
    # a wall time belongs to the first period whose end, told in that period's own wall time, lies beyond it
    ends = at[1:] + off[:-1]
    k = np.searchsorted(ends, wall, side="right")
    return wall - np.where((k > 0) & (wall < at[k] + off[k]), off[np.maximum(k - 1, 0)], off[k]), True


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _zone_minutes(text: str) -> int | None:
    t = re.sub(r"^(UTC|GMT)\s?(?=[+-])", "", text)
    if m := re.fullmatch(r"([+-])(\d{1,2}):?(\d\d)?", t):
        return (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0))
    return ABBREVIATIONS.get(t)


def _convert(kind: str, pattern: re.Pattern, values: list[str], zones: np.ndarray, mdy: np.ndarray, version: str) -> tuple[np.ndarray, np.ndarray]:
    """Instants (us) and validity of values of one mask."""
    hits = [pattern.fullmatch(v) for v in values]
    ok = np.array([h is not None for h in hits])
    get = lambda g, default=0: np.array([int(h[g]) if h and h[g] else default for h in hits], np.int64) if g in pattern.groupindex else np.full(len(hits), default, np.int64)
    if kind == "epoch":
        if "n" in pattern.groupindex:
            return get("n") * US, ok
        if "ms" in pattern.groupindex:
            return get("ms") * 1000, ok
        return (get("us"), ok) if "us" in pattern.groupindex else (get("ft") // 10 - FILETIME_EPOCH_US, ok)
    year = get("Y")
    year = np.where(year < 70, year + 2000, np.where(year < 100, year + 1900, year))
    if "a" in pattern.groupindex:
        a, b = get("a"), get("b")
        month_first = np.where(a > 12, False, np.where(b > 12, True, mdy))
        month, day = np.where(month_first, a, b), np.where(month_first, b, a)
    else:
        day = get("d")
        month = get("m") if "m" in pattern.groupindex else np.array([(MONTH_OF.get(n) or MONTH_OF.get(n[:3], 0)) if h and (n := h["mon"].lower()) else 0 for h in hits], np.int64)
    hour, minute, second = get("H"), get("M"), get("S")
    micro = np.array([int((h["frac"] or "0")[:6].ljust(6, "0")) if h else 0 for h in hits], np.int64) if "frac" in pattern.groupindex else 0
    if "ampm" in pattern.groupindex:
        half = np.array([(h["ampm"] or "").lower() if h else "" for h in hits])
        ok &= (half == "") | ((hour >= 1) & (hour <= 12))
        hour = np.where(half == "", hour, hour % 12 + 12 * (half == "p"))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok &= (month >= 1) & (month <= 12) & (hour <= 23) & (minute <= 59) & (second <= 60) & (year >= 1)
    safe = np.where(ok, month, 1)
    ok &= (day >= 1) & (day <= length[safe] + (leap & (safe == 2)))
    wall = (days_from_civil(year, safe, day) * 86400 + hour * 3600 + minute * 60 + second) * US + micro
    told = np.array([(h["zone"] or "").strip("[] ") if h else "" for h in hits], object)
    named = np.where(told == "", zones, told)
    out = wall.copy()
    for name in set(named):
        rows = named == name
        minutes = _zone_minutes(name) if name else None
        if minutes is not None:
            out[rows] = wall[rows] - minutes * 60 * US
        else:
            got, known = wall_to_utc(wall[rows], name, version) if name else (wall[rows], False)
            out[rows] = got
            ok[rows] &= known
    return out, ok


#: Parsers of at most so many masks are kept; a mask that is met again is mapped again.
MASKS = 50_000


def parsers_of(value: str) -> list[tuple[str, re.Pattern]]:
    """Parsers that may fit values of a mask: a parser's pattern tells no more than shapes, names of months and zones."""
    return [(k, p) for k, p in PARSERS if _shape_fits(p, value)]


def _shape_fits(pattern: re.Pattern, value: str) -> bool:
    """Whether some value of this value's mask may fit: letters and zone names are what differs within a mask."""
    if pattern.fullmatch(value):
        return True
    return any(c.isalpha() for c in value)


def parse_instants(values: pd.Series, zones: pd.Series, orders: pd.Series, version: str = "", plan: dict | None = None) -> pd.Series:
    """UTC microseconds (nullable) of each value; ``plan`` keeps the parsers of each mask between calls."""
    plan = {} if plan is None else plan
    if len(plan) > MASKS:
        plan.clear()
    text = values.fillna("").astype(str).str.strip().to_numpy(object)
    zone, mdy = zones.fillna("").to_numpy(object), (orders.fillna("") == "mdy").to_numpy()
    masks = np.array([mask(v) for v in text], object)
    out, ok = np.zeros(len(text), np.int64), np.zeros(len(text), bool)
    codes, distinct = pd.factorize(masks)
    for i, shape in enumerate(distinct):
        if not shape:
            continue
        rows = np.flatnonzero(codes == i)
        if shape not in plan:
            plan[shape] = parsers_of(text[rows[0]])
        for kind, pattern in plan[shape]:
            fits = np.array([pattern.fullmatch(text[r]) is not None for r in rows])
            if fits.any():
                mine = rows[fits]
                out[mine], ok[mine] = _convert(kind, pattern, [text[r] for r in mine], zone[mine], mdy[mine], version)
                rows = rows[~fits]
            if not len(rows):
                break
    return pd.Series(pd.array(out, dtype="Int64")).where(pd.Series(ok), pd.NA)


def utc_micros(version: str | None = None) -> Callable[[Column, Column, Column], Column]:
    """Arrow UDF (value, zone_name, date_order) -> UTC microseconds or null."""
    version = database_version() if version is None else version
    plan: dict = {}

    @F.pandas_udf(LongType())
    def convert(values: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
        if (here := database_version()) != version:
            raise RuntimeError(f"time zone database {here} here, {version} on the driver")
        return parse_instants(values, zones, orders, version, plan)

    return convert


def normalise_timestamps(df: DataFrame, fields: list[str], key: str, stores: DataFrame, store: str = "store_id", only_odd: bool = True) -> DataFrame:
    """(key, field, utc_us): one distinct row for each value that denotes an instant.

    ``only_odd`` leaves out values already in the standard form, in the JVM before any Python.
    The store table is broadcast only below Spark's own size threshold.
    """
    zones = stores.groupBy(F.col("store_id").alias(store)).agg(F.max("zone_name").alias("zone_name"), F.max("date_order").alias("date_order"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    long = df.select(key, store, cells.alias("c")).select(key, store, "c.field", "c.value").filter("value IS NOT NULL AND length(trim(value)) > 0")
    if only_odd:
        long = long.filter(~F.col("value").rlike(STANDARD))
    joined = long.distinct().join(zones, store, "left")
    return joined.select(key, "field", utc_micros()("value", "zone_name", "date_order").alias("utc_us")).filter("utc_us IS NOT NULL").distinct()
