"""From delivered records to consistent traces: validation, first-wins dedupe, and removal of broken or cut-off jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspan.operators.references import clean_key
from weftspan.operators.timestamps import SENTINELS, _unit
from weftspan.schemas import MANDATORY

MINUTE_NS = 60 * 10**9


def nanoseconds(c: Column) -> Column:
    """An integer Unix time of whatever unit in nanoseconds; null for null, sentinels and what nanoseconds cannot hold."""
    v = F.when(~c.isin(*SENTINELS), c.cast("bigint"))
    unit = _unit(v)
    scale = F.when(unit == "unix_s", 10**9).when(unit == "unix_ms", 10**6).when(unit == "unix_us", 1000).otherwise(1)
    return F.try_multiply(v, scale.cast("bigint"))


def valid_records(nodes: DataFrame) -> DataFrame:
    """Delivered rows in one form: ids cleaned, times in nanoseconds; rows without a mandatory field are left out."""
    rows = nodes.withColumns({
        "event_id": clean_key(F.col("event_id")), "parent_event_id": clean_key(F.col("parent_event_id")),
        "start_timestamp": nanoseconds(F.col("start_timestamp")), "end_timestamp": nanoseconds(F.col("end_timestamp")),
    })
    return rows.dropna(subset=list(MANDATORY))


def rejected_records(nodes: DataFrame, key: str = "id") -> DataFrame:
    """(key, reason): rows left out by :func:`valid_records`, with the fields they lack."""
    rows = nodes.withColumns({"event_id": clean_key(F.col("event_id")), "start_timestamp": nanoseconds(F.col("start_timestamp")), "end_timestamp": nanoseconds(F.col("end_timestamp"))})
    lacking = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in MANDATORY]), lambda x: x.isNotNull()), ",")
    return rows.select(F.col(key), F.concat(F.lit("without "), lacking).alias("reason")).where("reason != 'without '")


def first_records(rows: DataFrame, order: list[str], key: str = "event_id") -> DataFrame:
    """The first row of each key by ``order``. An aggregate of structs, so repeats are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in order and c != key]
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def duplicates(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, n_records) of keys delivered more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def spans_of(nodes: DataFrame) -> DataFrame:
    """The valid span of each event: cleaned rows, the first to arrive."""
    rows = valid_records(nodes).select("event_id", "ingested_at", "id", *[c for c in MANDATORY if c != "event_id"], "parent_event_id")
    return first_records(rows, ["ingested_at", "id"]).drop("ingested_at", "id")


def time_bounds(rows: DataFrame) -> DataFrame:
    """One row (min_timestamp, max_timestamp) of all delivered rows, repeats included."""
    return rows.agg(F.min("start_timestamp").alias("min_timestamp"), F.max("end_timestamp").alias("max_timestamp"))


def time_window(rows: DataFrame, buffer_minutes: int) -> tuple[int, int]:
    """Bounds shrunk by the buffer on either side; ValueError if nothing is left between them."""
    low, high = time_bounds(rows).first()
    low, high = (low or 0) + buffer_minutes * MINUTE_NS, (2**63 - 1 if high is None else high) - buffer_minutes * MINUTE_NS
    if low >= high:
        raise ValueError(f"a buffer of {buffer_minutes} minutes leaves no time between {low} and {high}")
    return low, high


def inconsistent_jobs(spans: DataFrame) -> DataFrame:
    """Jobs with a span whose parent exists under no job."""
    ids = spans.select(F.col("event_id").alias("parent_event_id"))
    return spans.where("parent_event_id is not null").join(ids, "parent_event_id", "left_anti").select("job_id").distinct()


def drop_inconsistent_jobs(spans: DataFrame) -> DataFrame:
    return spans.join(inconsistent_jobs(spans), "job_id", "left_anti")


def disconnected_jobs(spans: DataFrame) -> DataFrame:
    """Jobs with a span whose parent isn't in the same job."""
    ids = spans.select("job_id", F.col("event_id").alias("parent_event_id"))
    return spans.where("parent_event_id is not null").join(ids, ["job_id", "parent_event_id"], "left_anti").select("job_id").distinct()


def jobs_in_window(spans: DataFrame, low: int, high: int) -> DataFrame:
    """Jobs of which some span starts or ends within [low, high]; one that only covers it does not count."""
    inside = F.col("start_timestamp").between(low, high) | F.col("end_timestamp").between(low, high)
    return spans.where(inside).select("job_id").distinct()


def drop_jobs_outside(spans: DataFrame, low: int, high: int) -> DataFrame:
    return spans.join(jobs_in_window(spans, low, high), "job_id", "left_semi")


def root_counts(spans: DataFrame) -> DataFrame:
    """(job_id, n_roots)."""
    return spans.groupBy("job_id").agg(F.count_if(F.col("parent_event_id").isNull()).alias("n_roots"))


def name_jobs_by_root(spans: DataFrame) -> DataFrame:
    """Every span takes the job name of its job's root; of several roots the first name counts, jobs without keep theirs."""
    roots = spans.where("parent_event_id is null").groupBy("job_id").agg(F.min("job_name").alias("_root_name"))
    return spans.join(roots, "job_id", "left").withColumn("job_name", F.coalesce("_root_name", "job_name")).drop("_root_name").select(*spans.columns)


def clean(spans: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """Inconsistent jobs, then jobs outside the window, then job names: the order of the pipeline."""
    spans = drop_inconsistent_jobs(spans)
    if window:
        spans = drop_jobs_outside(spans, *window)
    return name_jobs_by_root(spans)
