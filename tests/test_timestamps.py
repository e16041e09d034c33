from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import duckdb
import pytest
from paths import MIDDLE

from weftspan.operators.timestamps import abbreviations, fit_mixture, normalise_timestamps
from weftspan.plans.problem_queries import p1_found

MON = "jan feb mar apr may jun jul aug sep oct nov dec".split()
EPOCH = datetime(1970, 1, 1)


def us(t: datetime, frac: str | None = "") -> int:
    return (t - EPOCH) // timedelta(microseconds=1) + int(((frac or "") + "000000")[:6])


def brute(text, zone, order):
    """An independent reader: the instant, or None."""
    if text is None:
        return None
    s = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?", s):
        whole, _, rest = s.partition(".")
        v = int(whole)
        for limit, up in ((10**11, 10**6), (10**14, 10**3), (10**17, 1)):
            if v < limit:
                return v * up + int((rest + "000000")[:6]) * up // 10**6
        return v // 1000
    half = frac = None
    tail = r"(?:[.,](\d+))?"
    end = r" ?(Z|z|[+-]\d\d(?::?\d\d)?(?:\[.*\])?|[A-Z]{2,5})?"
    try:
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)" + tail + end, s):
            t, frac, mark = datetime(*map(int, m.groups()[:6])), m[7], m[8]
        elif m := re.fullmatch(r"(\d{4})-(\d{3})T(\d\d):(\d\d):(\d\d)" + tail + end, s):
            t, frac, mark = datetime(int(m[1]), 1, 1) + timedelta(days=int(m[2]) - 1, hours=int(m[3]), minutes=int(m[4]), seconds=int(m[5])), m[6], m[7]
        elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(Z)", s):
            t, mark = datetime(*map(int, m.groups()[:6])), "Z"
        elif m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (\d+):(\d\d):(\d\d)" + tail + r"(?: (AM|PM))?", s):
            if order is None:
                return None
            d, mo = (int(m[1]), int(m[2])) if order == "DMY" else (int(m[2]), int(m[1]))
            half, h = m[8], int(m[4])
            h = h % 12 + 12 * (half == "PM") if half else h
            t, frac, mark = datetime(int(m[3]), mo, d, h, int(m[5]), int(m[6])), m[7], None
        elif m := re.fullmatch(r"(?:[A-Z][a-z]{2}, )?(\d+) ([A-Z][a-z]{2}) (\d{4}) (\d\d):(\d\d):(\d\d)" + tail + end, s):
            t, frac, mark = datetime(int(m[3]), MON.index(m[2].lower()) + 1, int(m[1]), int(m[4]), int(m[5]), int(m[6])), m[7], m[8]
        else:
            return None
    except ValueError:
        return None
    if mark in ("Z", "z", "GMT", "UTC"):
        return us(t, frac)
    if mark and mark[0] in "+-":
        o = re.sub(r"\[.*|:", "", mark)
        off = timedelta(hours=int(o[1:3]), minutes=int(o[3:5] or 0))
        return us(t - off if o[0] == "+" else t + off, frac)
    if zone is None:
        return None
    z = ZoneInfo(zone)
    if mark:
        for fold in (0, 1):
            for shift in (-1, 0, 1):
                u = t.replace(tzinfo=UTC) - t.replace(tzinfo=z, fold=fold).utcoffset() + timedelta(hours=shift)
                for probe in (u, u + timedelta(days=150), u - timedelta(days=150)):
                    if probe.astimezone(z).tzname() == mark:
                        return us(t - probe.astimezone(z).utcoffset(), frac)
        return None
    return us(t - t.replace(tzinfo=z, fold=0).utcoffset(), frac)


def test_found_against_brute_force(spark):
    apps = {a: (z, o) for a, z, o in duckdb.sql(f"select application_name, home_zone, date_order from '{MIDDLE}/applications.parquet'").fetchall()}
    want = set()
    for i, text, app in duckdb.sql(f"select pv_id, pv_timestamp, application_name from '{MIDDLE}/pv_events.parquet'").fetchall():
        at = brute(text, *apps.get(app, (None, None)))
        if at is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z", text):
            want.add(("pv_events", i, at))
    for i, v in duckdb.sql(f"select id, start_timestamp from '{MIDDLE}/nodes.parquet'").fetchall():
        if v not in (None, 0, 2**63 - 1) and v < 10**17:
            want.add(("nodes", i, v * (10**6 if v < 10**11 else 10**3 if v < 10**14 else 1)))
    rows = [tuple(r) for r in p1_found(spark, MIDDLE).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


REGISTRY = [("ny", "America/New_York", "MDY"), ("berlin", "Europe/Berlin", "DMY"), ("odd", "Nowhere/Land", "XYZ"), (None, "UTC", "DMY")]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REGISTRY, "application_name string, home_zone string, date_order string")


def read(spark, registry, rows, arrived=None):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id int, application_name string, t string, _source string").withColumn("ts_status", df_lit())
    return [(r.ts_instant_us, r.ts_status) for r in normalise_timestamps(df, "t", "application_name", arrived, registry).orderBy("id").collect()]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def at(*parts):
    return us(datetime(*parts))


def test_daylight_saving_and_marks(spark, registry):
    got = read(spark, registry, [
        ("ny", "2025-11-02 01:30:00"), ("ny", "2025-11-02 01:30:00 EST"), ("ny", "2025-11-02 01:30:00 EDT"), ("ny", "2025-03-09 02:30:00"),
        ("berlin", "31/12/2024 11:59:59 PM"), ("ny", "12/31/2024 12:00:00 AM"), ("ny", "31/12/2024 10:00:00"), ("berlin", "2025-06-01 10:00 CET"),
        ("ny", "2025-06-01T10:00:00.1234567+02:00[Europe/Berlin]"), ("ny", "2025-06-01T10:00[America/New_York]"), ("ny", "10 Feb 2025 01:02:03 GMT"),
    ])
    assert got == [
        (at(2025, 11, 2, 5, 30), "registry"), (at(2025, 11, 2, 6, 30), "explicit"), (at(2025, 11, 2, 5, 30), "explicit"), (at(2025, 3, 9, 7, 30), "registry"),
        (at(2024, 12, 31, 22, 59, 59), "registry"), (at(2024, 12, 31, 5), "registry"), (None, "unreadable"), (at(2025, 6, 1, 9), "explicit"),
        (at(2025, 6, 1, 8, 0, 0, 123456), "explicit"), (at(2025, 6, 1, 14), "registry"), (at(2025, 2, 10, 1, 2, 3), "explicit"),
    ]


def test_nothing_to_read(spark, registry):
    got = read(spark, registry, [(None, None), ("ny", ""), ("ny", "  "), ("ny", "x" * 100_000), ("ny", "2025-02-30 10:00:00"), (None, "2025-02-03 10:00:00"), ("odd", "2025-02-03 10:00:00"), ("gone", "03/02/2025 10:00:00"), (None, "1739146315"), ("ny", "1739146315.9999999"), ("ny", "99999999999999999999")])
    assert got == [(None, "missing"), (None, "missing"), (None, "missing"), (None, "unreadable"), (None, "unreadable"), (None, "ambiguous"), (None, "ambiguous"), (None, "ambiguous"), (1739146315 * 10**6, "explicit"), (1739146315 * 10**6 + 999999, "explicit"), (None, "unreadable")]


def test_empty_table_and_shuffle_path(spark, registry):
    df = spark.createDataFrame([], "application_name string, t string")
    assert normalise_timestamps(df, "t", "application_name", None, registry).count() == 0
    df = spark.createDataFrame([("ny", "2025-01-02 03:04:05")] * 50 + [(None, "7")] * 3, "application_name string, t string")
    out = normalise_timestamps(df, "t", "application_name", None, registry, broadcast_rows=0).collect()
    assert sorted({(r.ts_instant_us, r.ts_status) for r in out}) == [(7 * 10**6, "explicit"), (at(2025, 1, 2, 8, 4, 5), "registry")] and len(out) == 53


def test_mixture_learns_the_order_of_a_source(spark):
    # 40 dates only DMY can be, 60 that both can be
    chosen, posterior = fit_mixture(["dmy:0", "dmy:0,mdy:0"], [40, 60])
    assert chosen == ["dmy", "dmy"] and posterior[1] > 0.95
    chosen, posterior = fit_mixture(["dmy:0,mdy:0"], [60])
    assert posterior == [0.5]
    # nearness to the arrival decides where the text cannot
    chosen, posterior = fit_mixture(["dmy:2,mdy:0"], [60])
    assert chosen == ["mdy"] and posterior[0] > 0.9


def test_posteriors_decide(spark, registry):
    """The same rows come out otherwise without the belief in registry and sizes, and without the mixture."""
    rows = [("ny", "02/03/2025 10:00:00", datetime(2025, 3, 2, 11)), ("ny", "1739146315", datetime(1970, 1, 21)), ("new", "03/02/2025 10:00:00 GMT", None), *[("new", "25/02/2025 10:00:00 GMT", None)] * 30]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, application_name string, t string, seen timestamp_ntz")

    def run(**settings):
        out = normalise_timestamps(df, "t", "application_name", "seen", registry, **settings).orderBy("id").limit(3).collect()
        return [(r.ts_layout, r.ts_status, r.ts_instant_us) for r in out]

    assert run() == [("mdy", "registry", at(2025, 2, 3, 15)), ("unix_s", "explicit", 1739146315 * 10**6), ("dmy", "inferred", at(2025, 2, 3, 10))]
    loose = run(against=1.0)
    assert loose[0][0] == "dmy" and loose[1][0] == "unix_ms"
    assert run(rounds=0)[2][1:] == ("ambiguous", None)


def test_second_occurrence_is_a_reading_and_belief_is_strong_at_any_size():
    chosen, posterior = fit_mixture(["iso:00,iso@second:01,iso@utc:01", "iso:00"], [5, 10**12])
    assert chosen == ["iso", "iso"] and posterior[0] > 0.999
    # a layout that is one in 10**12 of its source's rows is still read as its size says
    chosen, _ = fit_mixture(["unix_ns:00", "unix_ms:21,unix_ns:21,unix_s:20,unix_us:21"], [10**12, 1])
    assert chosen == ["unix_ns", "unix_s"]


def test_inferred_order_is_marked(spark, registry):
    rows = [("new", "25/02/2025 10:00:00 GMT")] * 30 + [("new", "03/02/2025 10:00:00 GMT")]
    assert read(spark, registry, rows)[-1] == (at(2025, 2, 3, 10), "inferred")


def test_abbreviations():
    assert abbreviations("America/St_Johns")["NDT"] == -9000 and abbreviations("Europe/London")["GMT"] == 0


def test_extreme_integers(spark, registry):
    from pyspark.sql import functions as F

    from weftspan.operators.cleaning import nanoseconds
    from weftspan.operators.timestamps import unix_instant_us

    values = [None, 0, 2**63 - 1, -(2**63), 1, -1, 10**11 - 1, 10**14 - 1, 10**17 - 1, 10**17, 1_700_000_000]
    df = spark.createDataFrame([(i, v, "ny") for i, v in enumerate(values)], "i int, t bigint, application_name string")
    got = [r[0] for r in df.select(unix_instant_us(F.col("t"))).collect()]
    assert got[:3] == [None] * 3 and got[3:] == [-(2**63) // 1000, 10**6, -(10**6), (10**11 - 1) * 10**6, (10**14 - 1) * 1000, 10**17 - 1, 10**14, 1_700_000_000 * 10**6]
    assert [r[0] for r in df.select(nanoseconds(F.col("t"))).collect()][-3:] == [None, 10**17, 1_700_000_000 * 10**9]
    rows = normalise_timestamps(df, "t", "application_name", None, registry, integers=True).orderBy("i").collect()
    assert [r.ts_status for r in rows] == ["missing"] * 3 + ["explicit"] * 8 and [r.ts_instant_us for r in rows][3:] == got[3:]
