"""Analytics over the event log of conversion, view and render jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.names import extension, failure_fingerprint

#: Thresholds of the verdict.
THRESHOLDS = {"rss_per_mb_p95": 20.0, "duration_p95_ms": 60_000.0, "peak_rss_mb": 3200.0, "failure_rate": 0.05, "cpu_fraction": 0.30, "min_samples": 5}


def look_back(log: DataFrame, days: int, as_of: str | None = None) -> DataFrame:
    """Rows of the last `days` (1 to 365) before as_of, by default the log's newest time; never the clock's."""
    days = min(365, max(1, days))
    if as_of:
        return log.where(F.col("ts") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    newest = log.agg(F.max("ts").alias("newest"))
    return log.join(F.broadcast(newest)).where(F.col("ts") > F.col("newest") - F.make_dt_interval(F.lit(days))).drop("newest")  # one row


def triggered(log: DataFrame, trigger: str = "all") -> DataFrame:
    return {"audit": log.where("run_id is not null"), "user": log.where("run_id is null"), "all": log}[trigger]


def conversion_metrics(log: DataFrame) -> DataFrame:
    """By source extension and target: counts, exact percentiles, size ratios and rates of conversion jobs."""
    jobs = log.where("action = 'convert'").withColumns({"source_ext": extension(F.col("file_key")), "mb": F.col("read_bytes") / 1048576})
    failed = F.col("status").isin("error", "failed")
    n = F.count("*")
    return jobs.groupBy("source_ext", "target").agg(
        n.alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(F.col("status").isin("ok", "done")).alias("n_ok"), F.expr("percentile(duration_ms, 0.5)").alias("duration_p50"),
        F.expr("percentile(duration_ms, 0.95)").alias("duration_p95"), F.max("duration_ms").alias("duration_max"), F.max(F.col("peak_kb") / 1024).alias("peak_rss_mb"),
        F.expr("percentile(peak_kb / 1024 / mb, 0.95) filter (where mb > 0)").alias("rss_per_mb_p95"),
        F.when(F.sum("duration_ms") > 0, F.sum("cpu_ms") / F.sum("duration_ms")).alias("cpu_fraction"), (F.count_if(failed) / n).alias("failure_rate"),
    )


def verdict(metrics: DataFrame, overrides: Mapping[str, object] | None = None) -> DataFrame:
    """Adds signals, comma-joined: thresholds that a row exceeds. Few samples or a null never fire; unknown overrides are dropped, numeric strings read."""
    limits = dict(THRESHOLDS)
    for k, v in (overrides or {}).items():
        if k in limits:
            limits[k] = float(v)

    def signal(name: str, fires: Column) -> Column:
        return F.when(fires, F.lit(name))

    fired = F.array_compact(
        F.array(
            signal("rss_per_mb", F.col("rss_per_mb_p95") > limits["rss_per_mb_p95"]), signal("duration", F.col("duration_p95") > limits["duration_p95_ms"]),
            signal("peak_rss", F.col("peak_rss_mb") > limits["peak_rss_mb"]), signal("failures", F.col("failure_rate") > limits["failure_rate"]), signal("cpu", F.col("cpu_fraction") < limits["cpu_fraction"]),
        )
    )
    return metrics.withColumn("signals", F.when(F.col("n") >= limits["min_samples"], F.array_join(fired, ",")).otherwise(""))


def newest_per_cell(log: DataFrame, n: int) -> DataFrame:
    """The newest n audit jobs of each file and target."""
    rank = F.row_number().over(Window.partitionBy("file_key", "target").orderBy(F.desc("id")))
    return log.where("run_id is not null").withColumn("rank", rank).where(F.col("rank") <= n).select("file_key", "target", "id", "rank")


def run_progress(log: DataFrame, expected: int) -> DataFrame:
    """By run: ok, failed, skipped and pending jobs; done once none is pending. Queued and running jobs, and those of no status, are pending."""
    failed, skipped = F.col("status").isin("error", "failed"), F.col("status") == "skipped"
    open_ = F.coalesce(F.col("status").isin("queued", "running"), F.lit(True))
    runs = log.where("run_id is not null").groupBy("run_id").agg(
        F.count_if(~(failed | skipped | open_)).alias("ok"), F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"), F.max_by("file_key", "id").alias("newest_key")
    )
    pending = F.greatest(F.lit(expected) - F.col("ok") - F.col("failed") - F.col("skipped"), F.lit(0))
    return runs.withColumn("pending", pending.cast("long")).withColumn("state", F.when(pending == 0, "done").otherwise("running"))


def failure_fingerprints(errors: DataFrame) -> DataFrame:
    """Failures that differ only in times, paths and numbers are one: fingerprint, n, first_id."""
    print_ = failure_fingerprint(*(F.col(c) for c in ("source_ext", "target", "message", "traceback")))
    return errors.groupBy(print_.alias("fingerprint")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.min("ts").alias("first_seen"))


def open_failures(errors: DataFrame, closed: DataFrame) -> DataFrame:
    """Fingerprints that closed.fingerprint doesn't hold, with rank: most reproductions first, then by fingerprint."""
    rows = failure_fingerprints(errors).join(closed.select("fingerprint").distinct(), "fingerprint", "left_anti")
    # one row a fingerprint: a table of problems, not of jobs
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "fingerprint")))


def audit_page(
    log: DataFrame, user: int | None = None, action: str | None = None, target: str | None = None, statuses: Sequence[str] = (), contains: str | None = None, before_id: int | None = None, limit: int = 100
) -> DataFrame:
    """A page of the log, newest first: all filters that are given hold; contains goes by any case; limit is 1 to 500."""
    for column, value in (("user_id", user), ("action", action), ("target", target)):
        log = log if value is None else log.where(F.col(column) == value)
    if statuses:
        log = log.where(F.col("status").isin(*statuses))
    if contains:
        log = log.where(F.contains(F.lower("file_key"), F.lit(contains.lower())))
    if before_id is not None:
        log = log.where(F.col("id") < before_id)
    return log.orderBy(F.desc("id")).limit(min(500, max(1, limit)))


def run_jobs(log: DataFrame, statuses: Sequence[str] = ()) -> DataFrame:
    """Jobs of all runs (or those of some statuses) with rank: their stable order in a run by file, target and id."""
    jobs = log.where("run_id is not null")
    jobs = jobs.where(F.col("status").isin(*statuses)) if statuses else jobs
    return jobs.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("file_key", "target", "id")))


def runs_page(log: DataFrame, limit: int = 20, before: str | None = None) -> DataFrame:
    """Runs that started before a time, newest first: run_id, started, jobs, job_ms (the summed time of their jobs)."""
    runs = log.where("run_id is not null").groupBy("run_id").agg(F.min("ts").alias("started"), F.count("*").alias("jobs"), F.sum("duration_ms").alias("job_ms"))
    runs = runs.where(F.col("started") < F.lit(before).cast("timestamp_ntz")) if before else runs
    return runs.orderBy(F.desc("started"), "run_id").limit(limit)


def users_and_jobs(users: DataFrame, log: DataFrame) -> DataFrame:
    """user_id, name, jobs, failed of all users, those without a job too, and of jobs whose user is unknown (name null)."""
    per = log.groupBy("user_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status").isin("error", "failed")).alias("failed"))
    return users.join(per, "user_id", "full_outer").select("user_id", "name", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("failed", F.lit(0)).alias("failed"))


#: Fields of a render window.
RENDER = ("fps_p50", "fps_min", "frame_ms_p50", "frame_ms_p95", "gpu_ms_p50", "draw_calls", "triangles", "long_frames", "frame_count")


def render_metrics(log: DataFrame) -> DataFrame:
    """By file of render windows: medians, extremes and sums, and whether the processor or the graphics card bounds it; empty numbers are none."""
    rows = log.where("action = 'render' and client_metrics is not null and file_key is not null")
    rows = rows.select("file_key", *(F.nullif(F.get_json_object("client_metrics", f"$.{c}"), F.lit("")).try_cast("double").alias(c) for c in RENDER))
    half = {f"{c}_mid": F.expr(f"percentile({c}, 0.5)") for c in ("fps_p50", "frame_ms_p50", "gpu_ms_p50", "draw_calls", "triangles")}
    out = rows.groupBy("file_key").agg(
        F.count("*").alias("windows"), *(v.alias(k) for k, v in half.items()), F.min("fps_min").alias("fps_min"), F.expr("percentile(frame_ms_p95, 0.95)").alias("frame_ms_p95"),
        F.max("draw_calls").alias("draw_calls_max"), F.sum("long_frames").alias("long_frames"), F.sum("frame_count").alias("frames"),
    )
    cpu, gpu = F.col("frame_ms_p50_mid"), F.col("gpu_ms_p50_mid")
    bound = F.when(gpu.isNull() & cpu.isNull(), "unknown").when(cpu.isNull() | (gpu > cpu), "gpu").otherwise("cpu")
    return out.withColumn("bound", bound)


def catalogue_fingerprints(equipment: DataFrame, systems: DataFrame) -> DataFrame:
    """scope, fingerprint: 16 hex digits that change with any item that isn't archived. equipment: scope, slug, revision, cad_key, archived; systems without cad_key.

    A scope's catalogue is small (its items' names and revisions meet in one row).
    """

    def digest(items: DataFrame, name: str, *parts: Column) -> DataFrame:
        live = items.where(~F.col("archived")).groupBy("scope").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slug", F.concat_ws(":", *parts).alias("t")))), lambda x: x["t"]), ",").alias("t"))
        return live.select("scope", F.md5(F.col("t").cast("binary")).alias(name))

    revision = F.col("revision").cast("string")
    eq = digest(equipment, "eq", F.col("slug"), revision, F.coalesce("cad_key", F.lit("")))
    sy = digest(systems, "sy", F.col("slug"), revision)
    scopes = equipment.select("scope").union(systems.select("scope")).distinct()
    empty = F.md5(F.lit("").cast("binary"))
    both = scopes.join(eq, "scope", "left").join(sy, "scope", "left")
    return both.select("scope", F.substring(F.sha2(F.concat(F.lit("eq:"), F.coalesce("eq", empty), F.lit("|sy:"), F.coalesce("sy", empty)), 256), 1, 16).alias("fingerprint"))


def owners(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """derived_key, source_key: the longest source key that the derived key continues with '.' or '/'; null for orphans.

    Prefixes that end before such a sign are exploded and joined on equality.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length("derived_key") - 1), lambda i: F.substring(F.col("derived_key"), i + 1, F.lit(1)).isin(".", "/"))
    prefixes = derived.where(F.length("derived_key") > 1).select("derived_key", F.explode(F.transform(ends, lambda i: F.substring(F.col("derived_key"), F.lit(1), i))).alias("source_key"))
    found = prefixes.join(sources.select("source_key").distinct(), "source_key").groupBy("derived_key").agg(F.max_by("source_key", F.length("source_key")).alias("source_key"))
    return derived.select("derived_key").join(found, "derived_key", "left")


#: Fields of the client's metrics that are timed.
PHASES = ("ttfb_ms", "download_ms", "decompress_ms", "parse_ms", "prepare_ms", "first_render_ms")
CLIENT = ", ".join(f"{p} double" for p in PHASES) + ", profile_frames array<struct<fn: string, self_ms: double, total_ms: double>>"


def view_load_metrics(log: DataFrame) -> DataFrame:
    """By file of view jobs: counts, exact percentiles of the load's phases, and the class (io, network, cpu, gpu) with the largest median; earlier ones win ties.

    Phases are read from the JSON in client_metrics; one that is missing doesn't count in its percentile. Without any time the class is unknown.
    """
    loads = log.where("action = 'view' and client_metrics is not null and file_key is not null").withColumn("m", F.from_json("client_metrics", CLIENT))
    failed = F.col("status").isin("error", "failed")
    out = loads.groupBy("file_key").agg(
        F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.expr("percentile(duration_ms, 0.5)").alias("total_p50"), F.expr("percentile(duration_ms, 0.95)").alias("total_p95"),
        *(F.expr(f"percentile(m.{p}, 0.5)").alias(p) for p in PHASES),
    )
    zero = F.lit(0.0)
    known = {p: F.coalesce(p, zero) for p in PHASES}
    classes = {"io": known["ttfb_ms"], "network": known["download_ms"], "cpu": known["decompress_ms"] + known["parse_ms"] + known["prepare_ms"], "gpu": known["first_render_ms"]}
    most = F.greatest(*classes.values())
    dominant = F.when(most <= 0, "unknown")
    for name, took in classes.items():
        dominant = dominant.when(took == most, name)
    return out.withColumn("dominant", dominant)


def frame_hotspots(log: DataFrame, action: str = "view", limit: int = 100) -> DataFrame:
    """The functions with most self time over all profiled frames of view or render jobs: fn, samples, self_ms, mean_ms, total_max, is_wasm."""
    frames = log.where(F.col("action") == action).select(F.explode(F.from_json("client_metrics", CLIENT)["profile_frames"]).alias("f")).select("f.*").where("fn <> ''")
    sums = frames.groupBy("fn").agg(F.count("*").alias("samples"), F.sum("self_ms").alias("self_ms"), F.avg("self_ms").alias("mean_ms"), F.max("total_ms").alias("total_max"))
    return sums.orderBy(F.desc_nulls_last("self_ms"), "fn").limit(limit).withColumn("is_wasm", F.lower("fn").contains("wasm"))


def top_functions(profiles: DataFrame, keep: int) -> DataFrame:
    """Each job's `keep` functions of most cumulative time, with rank from 0."""
    rank = F.row_number().over(Window.partitionBy("audit_id").orderBy(F.desc("cumtime"), "func")) - 1
    return profiles.withColumn("rank", rank).where(F.col("rank") < keep)


def profile_hotspots(profiles: DataFrame, log: DataFrame, source_ext: str | None = None, limit: int = 25) -> DataFrame:
    """The functions with most cumulative time over the conversions of one source extension: func, cumtime, ncalls, profiles."""
    jobs = log.where("action = 'convert'")
    if source_ext:
        jobs = jobs.where(extension(F.col("file_key")) == source_ext.lower().lstrip("."))
    met = profiles.join(jobs.select(F.col("id").alias("audit_id")), "audit_id")
    sums = met.groupBy("func").agg(F.sum("cumtime").alias("cumtime"), F.sum("ncalls").alias("ncalls"), F.count_distinct("audit_id").alias("profiles"))
    return sums.orderBy(F.desc("cumtime"), "func").limit(limit)


def with_newest_run(parity: DataFrame, log: DataFrame) -> DataFrame:
    """parity rows (job_id, ...) with the run_id of the job's newest log row, null where no row has one."""
    runs = log.where("run_id is not null").groupBy("job_id").agg(F.max_by("run_id", "id").alias("run_id"))
    return parity.join(runs, "job_id", "left")
