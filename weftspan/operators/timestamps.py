"""Mixed timestamp formats and zones: one unambiguous UTC instant per record.

Every value is read in every way that is plausible, by built-in expressions only: a number in each unit that gives an
instant in range, a date with slashes in both orders, a wall-clock time in the source's home zone, as its second
occurrence where it has two, and in UTC. A reading has a layout, a distance from the record's arrival, and a belief:
whether the registry (the source's order and zone) or, for numbers, their size speaks for it or against it.

A value's readings form a small signature. Signatures are counted per source, and a mixture over layouts is fitted to
each source's counts by expectation-maximisation: a value adds to the likelihood under each of its readings, and the
posterior (layout's share x nearness x belief) picks one. Belief is strong (``against``), so that a registered source
is read as registered; where the registry is silent, the source's other values and the arrival decide. Where no reading
reaches ``decide_at`` the record is marked ``ambiguous``.

Defined results
---------------
null or blank text            ``missing``, no instant
text no layout fits           ``unreadable``, no instant
wall-clock without zone       instant by the source's home zone (``registry``); without a registered zone
                              ``ambiguous``, no instant
wall-clock that occurs twice  the first one, unless an abbreviation or offset says otherwise
wall-clock that was skipped   by the offset in force before the change
date with slashes             by the registered order, ``unreadable`` if it is no date in that order; without one
                              ``inferred`` if the posterior decides and the zone is written, else ``ambiguous``
sentinels (integers only)     0 and 2**63-1 count as ``missing``
finer digits than micro       cut off
Input columns of any name are kept; the results are added under the names given by ``prefix`` and replace a column of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.runtime import BROADCAST_ROWS, cut, epoch_us, join_small

SENTINELS = (0, 2**63 - 1)
UNITS = {"unix_s": 10**6, "unix_ms": 10**3, "unix_us": 1}  # microseconds; and unix_ns
#: Relative density of the distance from instant to arrival: within two days, within forty days, farther.
NEARNESS = (1.0, 0.1, 0.01)
#: Belief in a reading that the registry, or a number's size, speaks against, relative to one that it speaks for.
AGAINST = 1e-9
#: Each layout's share in a source's mixture is at least about so much, however many rows the source has, so that belief
#: outweighs it at any size.
LEAST_LAYOUT = 1e-3
#: Instants later or earlier than this many microseconds from 1970 are out of range: no unit is taken for such a reading.
RANGE_US = 10**17
DAY_US = 86_400_000_000
#: A change of a zone's offset lies no farther than this after a wall-clock time that it makes ambiguous.
AFTER_US = 3 * 3_600_000_000

_TIME = r"(\d{2}):(\d{2})(?::(\d{2}))?(?:[.,](\d+))?"
_ZONE = r"(?: ?([Zz]|[+-]\d{2}(?::?\d{2})?)(?:\[[^\]]*\])?|(\[[^\]]+\])| ([A-Za-z]{2,5}))?"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: layout -> pattern and the order of its groups: three date fields, hour, minute, second, fraction, half, offset, region, abbreviation
_LAYOUTS = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|$10"),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9|$10"),
    "ordinal": (rf"^(\d{{4}})-?(\d{{3}})[Tt ]{_TIME}{_ZONE}$", "$1||$2|$3|$4|$5|$6||$7|$8|$9"),
    "slash": (r"^(\d{1,2})/(\d{1,2})/(\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d+))?(?: ?([AaPp])\.?[Mm]\.?)?" + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|$11"),
    "textual": (r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d+))?(?: ?([AaPp])\.?[Mm]\.?)?" + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|$11"),
}


def abbreviations(zone: str, months: Iterable[int] = range(1, 13)) -> dict[str, int]:
    """Zone abbreviations of an IANA zone with their offsets in seconds; the latest meaning of each counts."""
    z, out = ZoneInfo(zone), {"GMT": 0, "UTC": 0, "UT": 0}
    for year in range(1990, 2038):
        for month in months:
            t = datetime(year, month, 15, tzinfo=UTC).astimezone(z)
            name = t.tzname() or ""
            if name.isalpha() and name not in ("GMT", "UTC", "UT"):
                out[name] = int(t.utcoffset().total_seconds())
    return out


def zone_table(registry: DataFrame, zone: str, order: str, key: str) -> DataFrame:
    """Registry as (_source, _zone, _order, _abbr); zones and orders that mean nothing become null.

    The number of distinct zones is bounded by the zone database, so they may be gathered on the driver.
    """
    spark = registry.sparkSession
    known = available_timezones()
    zones = [r[0] for r in registry.select(zone).distinct().collect() if r[0] in known]
    meanings = spark.createDataFrame([(z, abbreviations(z)) for z in zones], "_zone string, _abbr map<string,int>")
    one = registry.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_source")).agg(F.min(zone).alias("_zone"), F.min(F.upper(F.trim(order))).alias("_order"))
    return one.join(F.broadcast(meanings), "_zone", "left").select(
        "_source", F.when(F.col("_abbr").isNotNull(), F.col("_zone")).alias("_zone"), F.when(F.col("_order").isin("DMY", "MDY"), F.col("_order")).alias("_order"), "_abbr"
    )


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _micros(fraction: Column) -> Column:
    return F.coalesce(F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("bigint"), F.lit(0))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01; null for dates that do not exist."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = m.between(1, 12) & (d >= 1) & (d <= last) & (y >= 1)
    return F.unix_date(F.make_date(F.when(good, y), m, F.when(good, d)))


def _unit(v: Column) -> Column:
    """The unit a Unix time is written in, by its size: the coarsest that gives an instant in range."""
    unit = F
    for name, us in UNITS.items():
        unit = unit.when((v < RANGE_US // us) & (v > -(RANGE_US // us)), name)
    return unit.when(v.isNotNull(), "unix_ns")


def _from_nanos(v: Column) -> Column:
    return F.floor(v / F.lit(1000).cast("decimal(4,0)")).cast("bigint")


def _unix_us(v: Column, unit: Column) -> Column:
    return F.when(unit == "unix_s", v * 1_000_000).when(unit == "unix_ms", v * 1000).when(unit == "unix_us", v).otherwise(_from_nanos(v))


def unix_instant_us(c: Column) -> Column:
    """Instant in microseconds of an integer Unix time of whatever unit, by its size; null for null and for sentinels."""
    v = F.when(~c.isin(*SENTINELS), c.cast("bigint"))
    return _unix_us(v, _unit(v))


@dataclass(frozen=True)
class Reading:
    """One way to read a value: columns that are null where it does not apply."""

    layout: Column
    us: Column  # null if the zone is unknown
    valid: Column
    basis: Column
    trusted: Column  # the registry or the size speaks for it, or is silent


def _number_readings(number: Column, rest: Column | None = None) -> list[Reading]:
    """A Unix time in each unit that gives an instant in range; the coarsest has the belief. ``rest``: digits after the point, as micros."""
    out, coarser = [], F.lit(False)
    explicit = F.lit("explicit")
    for name, us in UNITS.items():
        valid = (number < RANGE_US // us) & (number > -(RANGE_US // us))
        value = F.when(valid, number * us)
        if rest is not None and us > 1:
            part = F.floor(rest * us / F.lit(10**6).cast("decimal(8,0)")).cast("bigint")
            value = value + F.when(F.col("_text").startswith("-"), -part).otherwise(part)
        out.append(Reading(F.lit(name), value, valid, explicit, ~coarser))
        coarser = coarser | valid
    return [*out, Reading(F.lit("unix_ns"), _from_nanos(number), number.isNotNull(), explicit, ~coarser)]


def _read_text(df: DataFrame, value: str) -> tuple[DataFrame, list[Reading]]:
    """Split the text once, by the one layout its marks allow, and give its readings. Needs _zone, _order and _abbr."""
    df = df.withColumn("_text", F.btrim(F.col(value).cast("string"), F.lit(" \t\n\x0b\f\r")))
    mark = lambda i: F.substring("_text", i, 1)
    guess = (
        F.when(F.col("_text").contains("|"), None).when(F.instr("_text", "/").isin(2, 3), "slash").when((mark(5) == "-") & (mark(8) == "-"), "iso")
        .when((mark(5) == "-") | mark(8).isin("T", "t", " ") & mark(5).between("0", "9"), "ordinal").when(mark(9).isin("T", "t") & mark(8).between("0", "9"), "compact").otherwise("textual")
    )
    df = df.withColumn("_guess", guess)
    split = F
    for name, (pattern, groups) in _LAYOUTS.items():
        split = split.when(F.col("_guess") == name, F.regexp_replace("_text", pattern, groups))
    df = df.withColumn("_split", split)
    df = df.withColumn("_kind", F.when(F.col("_split").contains("|"), F.col("_guess"))).withColumn("_f", F.when(F.col("_kind").isNotNull(), F.split("_split", r"\|")))
    f = lambda i: F.col("_f").getItem(i)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(f(1))).cast("int")
    y, b, c = _int(f(0)), F.when(F.col("_kind") == "textual", month).otherwise(_int(f(1))), _int(f(2))
    hour, minute, second = _int(f(3)), _int(f(4)), F.when(f(5) == "", 0).otherwise(_int(f(5)))
    half = F.lower(f(7))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    clock = F.when(hour24.between(0, 23) & minute.between(0, 59) & second.between(0, 59), (hour24.cast("bigint") * 3600 + minute * 60 + second) * 1_000_000 + _micros(f(6)))
    day = lambda mm, dd: _days(y, mm, dd).cast("bigint") * DAY_US
    ordinal = F.when((c >= 1) & (c <= F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 366).otherwise(365)), (_days(y, F.lit(1), F.lit(1)) + c - 1).cast("bigint") * DAY_US)
    slash = F.col("_kind") == "slash"
    offset = F.replace(f(8), F.lit(":"), F.lit(""))
    minutes = F.when(F.lower(offset) == "z", 0).otherwise(F.when(offset.startswith("-"), -1).otherwise(1) * (_int(F.substring(offset, 2, 2)) * 60 + F.coalesce(_int(F.substring(offset, 4, 2)), F.lit(0))))
    abbr = F.upper(f(10))
    seconds = F.when(f(8) != "", minutes * 60).when(f(10) != "", F.when(abbr.isin("GMT", "UTC", "UT"), 0).otherwise(F.try_element_at("_abbr", abbr)))
    # a region alone counts only where it is the source's own, which is known to be a valid zone
    region = F.when(F.translate(f(9), "[]", "") == F.col("_zone"), F.col("_zone"))
    plain = F.col("_kind").isNull() & F.col("_text").rlike(r"^-?\d{1,19}(\.\d+)?$")
    df = df.withColumns({
        "_clock": clock, "_day1": F.when(F.col("_kind") == "ordinal", ordinal).when(F.col("_kind").isNotNull(), day(b, c)), "_day2": F.when(slash, day(c, b)),
        "_seconds": seconds.cast("bigint") * 1_000_000, "_bare": (f(8) == "") & (f(9) == "") & (f(10) == ""), "_region": F.when(f(9) != "", region),
        "_number": F.when(plain, F.split_part("_text", F.lit("."), F.lit(1)).try_cast("bigint")), "_rest": F.when(plain, _micros(F.split_part("_text", F.lit("."), F.lit(2)))),
    })
    zone = F.coalesce("_region", F.when(F.col("_bare"), F.col("_zone")))
    to_utc = lambda local: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))
    wall, new = F.col("_seconds").isNull() & zone.isNotNull(), {}
    for i in ("1", "2"):
        local = F.col(f"_day{i}") + F.col("_clock")
        first = F.when(F.col("_seconds").isNotNull(), local - F.col("_seconds")).when(wall, to_utc(local))
        # by the offset some hours later; it is another reading if the clock showed this time under both
        later = local - (local + AFTER_US - to_utc(local + AFTER_US))
        new |= {f"_local{i}": local, f"_us{i}": first, f"_later{i}": F.when(wall, later)}
    df = df.withColumns(new)
    for i in ("1", "2"):
        again = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col(f"_later{i}")), zone)) == F.col(f"_local{i}")
        df = df.withColumn(f"_twice{i}", F.when(F.col(f"_later{i}") > F.col(f"_us{i}"), again).otherwise(False))
    named = F.when(F.col("_seconds").isNotNull(), "explicit").when(F.col("_bare") | F.col("_region").isNotNull(), F.when(F.col("_zone").isNotNull(), "registry").otherwise("no zone"))
    readings, no = _number_readings(F.col("_number"), F.col("_rest")), F.lit(False)
    for i, layout, order in (("1", F.when(slash, "dmy").otherwise(F.col("_kind")), "DMY"), ("2", F.lit("mdy"), "MDY")):
        fits = F.col(f"_local{i}").isNotNull() & named.isNotNull()
        ordered = ~slash | F.coalesce(F.col("_order") == order, F.lit(True))
        readings += [
            Reading(layout, F.col(f"_us{i}"), fits, named, ordered),
            Reading(F.concat(layout, F.lit("@second")), F.col(f"_later{i}"), fits & F.col(f"_twice{i}"), named, no),
            Reading(F.concat(layout, F.lit("@utc")), F.col(f"_local{i}"), fits & F.col("_bare") & F.col("_zone").isNotNull(), named, no),
        ]
    return df, readings


def fit_mixture(signatures: list[str], counts: list[float], smooth: float = 0.5, rounds: int = 200, against: float = AGAINST) -> tuple[list[str], list[float]]:
    """EM for one source. A signature is ``layout:nearness[belief]`` of each valid reading, joined by commas.

    Returns the layout with the highest posterior for each signature, and that posterior. ``smooth`` (and a share of
    ``LEAST_LAYOUT``) is added to the expected count of every layout the source shows, so that a layout never seen alone
    isn't ruled out. With no ``rounds`` all layouts have the same share. Ties go to the first layout by name, with a
    posterior that shows the tie.
    """
    sets = [[tuple(x.split(":")) for x in s.split(",")] for s in signatures]
    layouts = sorted({name for s in sets for name, _ in s})
    at = {name: i for i, name in enumerate(layouts)}
    like = np.zeros((len(sets), len(layouts)))
    for i, s in enumerate(sets):
        for name, code in s:
            like[i, at[name]] = NEARNESS[int(code[0])] * (against if code[1:] == "1" else 1.0)
    n, theta = np.asarray(counts, dtype=float), np.full(len(layouts), 1 / len(layouts))
    smooth = max(smooth, LEAST_LAYOUT * n.sum())
    for _ in range(rounds):
        joint = like * theta
        post = joint / joint.sum(axis=1, keepdims=True)
        new = n @ post + smooth
        new /= new.sum()
        done = np.abs(new - theta).max() < 1e-9
        theta = new
        if done:
            break
    joint = like * theta
    post = joint / joint.sum(axis=1, keepdims=True)
    best = post.argmax(axis=1)
    return [layouts[i] for i in best], [float(p) for p in post[np.arange(len(sets)), best]]


def normalise_timestamps(df: DataFrame, value: str, source: str, arrived: str | None, registry: DataFrame, *, integers: bool = False, zone: str = "home_zone", order: str = "date_order", key: str = "application_name", prefix: str = "ts_", decide_at: float = 0.9, against: float = AGAINST, rounds: int = 200, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``{prefix}instant_us``, ``{prefix}layout``, ``{prefix}status`` and ``{prefix}posterior`` to every row.

    ``value`` is text, or an integer Unix time with ``integers=True``. ``arrived`` is a timestamp column that places
    readings in time; None if there is none. One pass over the rows counts signatures (map-side combined, so a hot
    source costs nothing), a second one applies the choice; nothing else is shuffled.
    """
    here = epoch_us(df, arrived) if arrived else F.lit(None).cast("bigint")
    rows = df.select(F.struct("*").alias("_row"), F.col(value).alias("_value"), F.col(source).alias("_source"), here.alias("_here"))
    if integers:
        number = F.when(~F.col("_value").isin(*SENTINELS), F.col("_value").cast("bigint"))
        rows, readings = rows.withColumn("_number", number), _number_readings(F.col("_number"))
        blank = F.col("_number").isNull()
    else:
        rows, readings = _read_text(join_small(rows, zone_table(registry, zone, order, key), ["_source"], "left", broadcast_rows), "_value")
        blank = F.col("_text").isNull() | (F.col("_text") == "")

    def near(us: Column) -> Column:
        far = F.abs(us - F.col("_here"))
        return F.when(far.isNull() | (far <= 2 * DAY_US), "0").when(far <= 40 * DAY_US, "1").otherwise("2")

    parts = [F.when(r.valid, F.concat(r.layout, F.lit(":"), near(r.us), F.when(r.trusted, "0").otherwise("1"))) for r in readings]
    trusted = reduce(Column.__or__, [F.coalesce(r.valid & r.trusted, F.lit(False)) for r in readings])
    by_order = F.lit(False) if integers else F.coalesce(F.col("_kind") == "slash", F.lit(False))
    order_known = F.lit(False) if integers else F.col("_order").isNotNull()
    # texts are read once: what the readings say is written, and counted and chosen from the table
    read = rows.select(
        "_row", "_source", F.concat_ws(",", *parts).alias("_signature"), blank.alias("_blank"), trusted.alias("_trusted"), F.when(by_order, F.when(order_known, "registry").otherwise("inferred")).alias("_by_order"),
        F.coalesce(*[F.when(r.valid, r.basis) for r in readings]).alias("_basis"), *[F.when(r.valid, r.us).alias(f"_us{i}") for i, r in enumerate(readings)], *[F.when(r.valid, r.layout).alias(f"_layout{i}") for i, r in enumerate(readings)],
    )
    read = cut(read)
    counted = read.where("_signature != ''").groupBy("_source", "_signature").agg(F.count(F.lit(1)).alias("_n"))

    def fit(group: tuple, found: pd.DataFrame) -> pd.DataFrame:
        layouts, posterior = fit_mixture(found["_signature"].tolist(), found["_n"].tolist(), rounds=rounds, against=against)
        return pd.DataFrame({"_source": group[0], "_signature": found["_signature"], "_chosen": layouts, "_posterior": posterior})

    fitted = cut(counted.groupBy("_source").applyInPandas(fit, "_source string, _signature string, _chosen string, _posterior double"))
    null_safe = F.coalesce("_source", F.lit("\x00"))
    chosen = join_small(read.withColumn("_key", null_safe), fitted.select(null_safe.alias("_key"), "_signature", "_chosen", "_posterior"), ["_key", "_signature"], "left", broadcast_rows)
    us = F.coalesce(*[F.when(F.col(f"_layout{i}") == F.col("_chosen"), F.col(f"_us{i}")) for i in range(len(readings))])
    status = (
        F.when(F.col("_blank"), "missing").when(~F.col("_trusted"), "unreadable")
        .when((F.col("_posterior") < decide_at) | (F.col("_basis") == "no zone"), "ambiguous").otherwise(F.coalesce("_by_order", "_basis"))
    )
    picked = chosen.withColumns({"_us": us, "_status": status})
    new = {f"{prefix}{x}" for x in ("instant_us", "layout", "status", "posterior")}
    return picked.select(
        *[F.col("_row").getField(c).alias(c) for c in df.columns if c not in new],
        F.when(F.col("_status").isin("explicit", "registry", "inferred"), F.col("_us")).alias(f"{prefix}instant_us"),
        F.col("_chosen").alias(f"{prefix}layout"), F.col("_status").alias(f"{prefix}status"), F.col("_posterior").alias(f"{prefix}posterior"),
    )
