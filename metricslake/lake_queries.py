"""Registered table scenarios: written to the shared checkpoint folder and read back.

Each query writes model tables derived from the given ones through the table functions and
returns what a reader then sees; every call uses a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake.ingest_queries import AS_OF, JOBS_AS_OF
from metricslake.ingest_queries import ORACLES as INGEST_ORACLES
from metricslake.operators import derived, ingest
from metricslake.oracle_derived import BENCH_VIEWS, LABELS, OK_MEANS, TIMING
from metricslake.params import BenchmarkFilters
from metricslake.plans import benchmark_reports as br
from metricslake.schemas import CI_REPOSITORIES, EXTENSION_DOWNLOADS
from metricslake.session import checkpoint_dir, configure
from metricslake.sources import change_log, lake, published
from metricslake.sources import download_files as dl
from metricslake.sources.adapters import model_table, with_views
from metricslake.streaming.landing import (
    BATCH_COL,
    MARKS,
    RUNS,
    commit_runs_and_mark,
    held_runs,
    landing_stream,
    late_period_load,
    publish_runs_and_mark,
    store_run_batch,
)

RUNS_PER_FILE = 500
NATIVE = BenchmarkFilters(storage_type="native", benchmarks=("tpch",))


def _folder(spark: SparkSession) -> str:
    configure(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/metricslake-tables/{uuid.uuid4().hex}"


def _flat(runs: DataFrame, *more: Column) -> DataFrame:
    plain = ["id", "status", "event", "html_url", "created_at", "updated_at"]
    return runs.select(*plain, F.col("repository.id").alias("repo_id"), F.col("repository.full_name").alias("repo"), *more)


def _land(rows: DataFrame, folder: str) -> None:
    """Records as files of one JSON array each, RUNS_PER_FILE ids a file."""
    arrays = rows.groupBy(F.expr(f"id div {RUNS_PER_FILE}")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("text"))
    arrays.select("text").write.option("maxRecordsPerFile", 1).text(folder)


def q_read_json_records(spark, sf_dir):
    path = f"{_folder(spark)}/repositories"
    _land(model_table(spark, sf_dir, "ci_repositories"), path)
    return lake.read_json_records(spark, path, CI_REPOSITORIES)


def q_create_table_as(spark, sf_dir):
    path = f"{_folder(spark)}/ci_runs"
    lake.create_table_as(spark, path, model_table(spark, sf_dir, "ci_runs"))
    lake.require_non_empty(spark, path, "ci_runs")
    return _flat(lake.read_lake_table(spark, path))


def q_append_records(spark, sf_dir):
    path, downloads = f"{_folder(spark)}/downloads", model_table(spark, sf_dir, "extension_downloads")
    lake.create_typed_table(spark, path, EXTENSION_DOWNLOADS)
    for repository in ("core", "community"):
        rows = downloads.where(F.col("repository") == repository)
        lake.append_records(spark, path, rows.select(*reversed(rows.columns)))  # by name, not by place
    return lake.read_lake_table(spark, path)


def q_copy_tables(spark, sf_dir):
    root = _folder(spark)
    lake.create_table_as(spark, f"{root}/lake/ci_jobs", model_table(spark, sf_dir, "ci_jobs"))
    lake.copy_tables(spark, f"{root}/lake", f"{root}/copy", ["ci_jobs", "missing"])
    return lake.read_lake_table(spark, f"{root}/copy/ci_jobs")


def q_materialize_derived(spark, sf_dir):
    root = _folder(spark)
    tables = [model_table(spark, sf_dir, n) for n in BENCH_VIEWS]
    lake.materialize_derived(spark, {"run_means": lambda: derived.warm_run_mean(*tables)}, root)
    return lake.read_lake_table(spark, f"{root}/run_means")


def q_compact_table(spark, sf_dir):
    path = f"{_folder(spark)}/downloads"
    rows = model_table(spark, sf_dir, "extension_downloads").repartition(8)
    rows.write.partitionBy("repository", "year").parquet(path)
    lake.compact_table(spark, path)
    return lake.read_lake_table(spark, path).select(*EXTENSION_DOWNLOADS.fieldNames())


def _kept(spark, sf_dir) -> DataFrame:
    runs = model_table(spark, sf_dir, "ci_runs")
    none = runs.limit(0).select(F.col("id").alias("repository_id"), F.col("id").alias("max_run_id"))
    return ingest.completed_prefix(runs, none, AS_OF)


def q_commit_runs_and_mark(spark, sf_dir):
    """The stored runs, each with the stored mark of its repository."""
    root = _folder(spark)
    commit_runs_and_mark(_kept(spark, sf_dir), 0, f"{root}/runs", f"{root}/marks")
    marks = lake.read_lake_table(spark, f"{root}/marks").drop(BATCH_COL).withColumnRenamed("repository_id", "repo_id")
    return _flat(lake.read_lake_table(spark, f"{root}/runs")).join(marks, "repo_id", "left")


#: Batches of the published-runs scenario: the ids by their remainder.
PUBLISHED_BATCHES = 3


def q_publish_runs_and_mark(spark, sf_dir):
    """Batches of runs published with their marks; each is run twice, and the last one once more
    without its pointer (a writer that stopped). Runs as stored, with the mark of their repository."""
    root, kept = _folder(spark), _kept(spark, sf_dir)
    for batch_id in range(PUBLISHED_BATCHES):
        batch = kept.where(F.col("id") % PUBLISHED_BATCHES == batch_id)
        for _ in range(2):
            publish_runs_and_mark(batch, batch_id, root)
    lake.create_table_as(spark, f"{root}/{RUNS}/v-stopped", kept)
    now = published.state(spark, root)
    marks = published.read(spark, root, MARKS, now).groupBy("repository_id").agg(F.max("max_run_id").alias("max_run_id"))
    return _flat(published.read(spark, root, RUNS, now)).join(marks.withColumnRenamed("repository_id", "repo_id"), "repo_id", "left")


def q_published_states(spark, sf_dir):
    """Two states of a set of derived tables, each read as of one moment: both tables, then one of them
    replaced by runs of one storage type, with the other as it was."""
    root = _folder(spark)
    runs, results, metrics = (model_table(spark, sf_dir, n) for n in BENCH_VIEWS)
    published.publish(spark, root, {"means": derived.warm_run_mean(runs, results, metrics), "attempts": derived.run_attempts(results)})
    native = runs.where(F.col("storage_type") == "native").select("run_id")
    published.publish(spark, root, {"means": published.read(spark, root, "means").join(native, "run_id", "left_semi")})

    def seen(number: int) -> DataFrame:
        at = published.state(spark, root, number)
        means = published.read(spark, root, "means", at).groupBy("run_id").agg(F.count("*").alias("n_means"))
        return means.join(published.read(spark, root, "attempts", at), "run_id").withColumn("state", F.lit(number))

    return seen(1).unionByName(seen(2))


def q_landing_stream(spark, sf_dir):
    """Stored runs, with a field that the model does not name and that only some records have."""
    root = _folder(spark)
    attempt = F.when(F.col("id") % 3 == 0, F.col("id") % 5)
    _land(model_table(spark, sf_dir, "ci_runs").withColumn("run_attempt", attempt), f"{root}/landing")
    query = landing_stream(spark, f"{root}/landing", f"{root}/lake", AS_OF, checkpoint=f"{root}/checkpoint")
    query.awaitTermination()
    stored = lake.read_lake_table(spark, f"{root}/lake/ci_runs")
    more = F.try_variant_get("record", "$.run_attempt", "bigint").alias("run_attempt")
    return _flat(stored, more)


#: Landings of the held-runs scenario: shares of the id range, in hundredths.
LANDINGS = ((0, 30), (60, 80), (20, 61))


def q_held_runs(spark, sf_dir):
    """Three landings: the second leaves a gap and is held; the third closes it for repositories
    whose landings then overlap. Returns stored runs, and those that still wait with their landing."""
    root = _folder(spark)
    runs = model_table(spark, sf_dir, "ci_runs")
    largest = runs.agg(F.max("id")).scalar()
    paths = [f"{root}/{t}" for t in ("runs", "marks", "retry")]
    for batch_id, (low, high) in enumerate(LANDINGS):
        landed = runs.where((F.col("id") * 100 >= largest * low) & (F.col("id") * 100 < largest * high))
        store_run_batch(spark, landed, batch_id, *paths, AS_OF)
    stored = lake.read_lake_table(spark, paths[0]).withColumn("landing", F.lit(None).cast("long"))
    return _flat(stored.drop(BATCH_COL).unionByName(held_runs(spark, paths[0])), F.col("landing").alias("waits_since"))


def q_late_period_load(spark, sf_dir):
    """Weekly files loaded by the stream; a second run of it adds nothing."""
    root = _folder(spark)
    roots = {name: f"{root}/files/{name}" for name in ("core", "community")}
    dl.write_stat_files(model_table(spark, sf_dir, "extension_downloads"), roots)
    for _ in range(2):
        late_period_load(spark, roots, f"{root}/downloads", checkpoint=f"{root}/checkpoint").awaitTermination()
    return lake.read_lake_table(spark, f"{root}/downloads").select(*EXTENSION_DOWNLOADS.fieldNames())


def q_read_download_stats(spark, sf_dir):
    """Weekly files of periods that are not stored yet (those of one repository before a year are)."""
    root, downloads = _folder(spark), model_table(spark, sf_dir, "extension_downloads")
    roots = {name: f"{root}/files/{name}" for name in ("core", "community")}
    dl.write_stat_files(downloads, roots)
    stored = downloads.where((F.col("repository") == "core") & (F.col("year") < 1999))
    return dl.read_download_stats(spark, roots, stored).valid


def q_read_lake_table(spark, sf_dir):
    """A table whose replacement stopped between its two renames, beside leftovers of an earlier stop."""
    path, jobs = f"{_folder(spark)}/ci_jobs", model_table(spark, sf_dir, "ci_jobs")
    lake.create_table_as(spark, f"{path}.__new_b", jobs)
    stored = spark.read.parquet(f"{path}.__new_b")  # the jobs are joined once; leftovers are taken from what is stored
    for leftover in ("__new_a", "__new_c", "__old_b"):
        lake.create_table_as(spark, f"{path}.{leftover}", stored.limit(3))
    return lake.read_lake_table(spark, path)


def q_create_typed_table(spark, sf_dir):
    path = f"{_folder(spark)}/downloads"
    for _ in range(2):  # the second call leaves the table alone
        lake.create_typed_table(spark, path, EXTENSION_DOWNLOADS)
        lake.append_records(spark, path, model_table(spark, sf_dir, "extension_downloads"))
    return lake.read_lake_table(spark, path)


def q_require_non_empty(spark, sf_dir):
    """Whether each table passes: one without rows, one with, and one that is not there."""
    root, names = _folder(spark), ("empty", "full", "missing")
    repos = model_table(spark, sf_dir, "ci_repositories")
    lake.create_table_as(spark, f"{root}/empty", repos, with_no_data=True)
    lake.create_table_as(spark, f"{root}/full", repos)
    passes = {}
    for name in names:
        try:
            lake.require_non_empty(spark, f"{root}/{name}")
            passes[name] = True
        except ValueError:
            passes[name] = False
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(passes[n]).alias("passes")) for n in names]))
    full = lake.read_lake_table(spark, f"{root}/full")
    return full.select("id", "full_name", "private", told.alias("t")).select("id", "full_name", "private", "t.name", "t.passes")


def _snapshots(spark, sf_dir) -> list[DataFrame]:
    """Four states of the runs: some change and return to an earlier value, others come and go."""
    runs = _flat(model_table(spark, sf_dir, "ci_runs"))
    third, seventh = F.col("id") % 3 == 0, F.col("id") % 7 == 0

    def with_status(*cases):
        status = F.col("status")
        for cond, value in cases:
            status = F.when(cond, value).otherwise(status)
        return runs.withColumn("status", status)

    return [
        runs.where("id % 5 <> 0"),
        with_status((seventh, "queued")).where("id % 5 <> 0 or id % 2 = 0"),
        with_status((seventh, "in_progress"), (third, "queued")).where("id % 11 <> 0"),
        with_status((seventh, "queued")).where("id % 5 <> 0"),
    ]


def _log(spark, sf_dir) -> DataFrame:
    path, states = f"{_folder(spark)}/changes", _snapshots(spark, sf_dir)
    for k in range(1, len(states)):
        change_log.record(spark, path, states[k - 1], states[k], ["id"], k)
    change_log.record(spark, path, states[1], states[2], ["id"], 2)  # once more: adds nothing
    return change_log.read(spark, path, 1, len(states) - 1)


def q_change_log_diff(spark, sf_dir):
    return change_log.new_values(_log(spark, sf_dir))


def q_change_log_net(spark, sf_dir):
    return change_log.net_changes(_log(spark, sf_dir), ["id"])


def q_runs_without_jobs_stored(spark, sf_dir):
    """Jobs stored by the month of their run; only the months of recent runs are read again."""
    path = f"{_folder(spark)}/ci_jobs"
    runs = model_table(spark, sf_dir, "ci_runs")
    jobs = ingest.with_run_month(model_table(spark, sf_dir, "ci_jobs"), runs).hint("rebalance", ingest.RUN_MONTH)
    jobs.write.partitionBy(ingest.RUN_MONTH).parquet(path)
    return ingest.runs_without_jobs(runs, lake.read_lake_table(spark, path), JOBS_AS_OF)


def q_approximate_baselines(spark, sf_dir):
    """Groups of baselines with their number of medians, and whether the approximate middle keeps its bound."""
    tables = [model_table(spark, sf_dir, n) for n in BENCH_VIEWS]
    times = derived.benchmark_query_times(*tables, ordered=False)
    path, keys = f"{_folder(spark)}/baseline_sketches", br.BASELINE_KEYS
    br.baseline_sketches(times).write.parquet(path)
    near = br.merged_baselines(lake.read_lake_table(spark, path), NATIVE)
    # the share of medians below the answer, and up to it, must have the middle between them
    ranked = br.pinned_times(times, NATIVE).where("median_seconds is not null").join(near, keys)
    below, upto = (F.avg(c.cast("double")) for c in (F.col("median_seconds") < F.col("baseline_seconds"), F.col("median_seconds") <= F.col("baseline_seconds")))
    error = F.greatest(below - 0.5, 0.5 - upto)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_medians"), (error <= br.SKETCH_ERROR).alias("within_bound"))


def q_run_labels(spark, sf_dir):
    configure(spark)
    labelled = derived.run_labels(derived.non_test_runs(model_table(spark, sf_dir, "runs")))
    return labelled.select("run_id", "run_date", "scale_factor_label", "benchmark_series", "cpu_arch_label", "machine_label")


QUERIES = {
    "read_json_records": q_read_json_records,
    "create_table_as": q_create_table_as,
    "append_records": q_append_records,
    "copy_tables": q_copy_tables,
    "materialize_derived": q_materialize_derived,
    "compact_table": q_compact_table,
    "commit_runs_and_mark": q_commit_runs_and_mark,
    "publish_runs_and_mark": q_publish_runs_and_mark,
    "published_states": q_published_states,
    "landing_stream": q_landing_stream,
    "run_labels": q_run_labels,
    "held_runs": q_held_runs,
    "late_period_load": q_late_period_load,
    "read_download_stats": q_read_download_stats,
    "read_lake_table": q_read_lake_table,
    "create_typed_table": q_create_typed_table,
    "require_non_empty": q_require_non_empty,
    "change_log_diff": q_change_log_diff,
    "change_log_net": q_change_log_net,
    "runs_without_jobs_stored": q_runs_without_jobs_stored,
    "approximate_baselines": q_approximate_baselines,
}

_STALE = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}' - INTERVAL {ingest.STALE_HOURS} HOUR"
# runs below the first fresh unfinished one of their repository
_STORED = f"""
select * from ci_runs r where not exists (
  select 1 from ci_runs u where u.repo_id = r.repo_id and u.id <= r.id
    and u.status <> 'completed' and u.updated_at > {_STALE})"""

# weekly files tell one update time for a period and repository
_WEEKLY = """select year, week, extension_name, downloads, last_update, repository from (
  select * replace (max(last_update) over (partition by year, week, repository) as last_update) from extension_downloads)"""


def _below_cut(rows: str) -> str:
    """Rows below the first fresh unfinished one of their repository among ``rows``."""
    return f"""select * from {rows} r where not exists (
  select 1 from {rows} u where u.repo_id = r.repo_id and u.id <= r.id and u.status <> 'completed' and u.updated_at > {_STALE})"""


# written for this scenario: the first landing has no mark to reach, the second lies beyond a gap, so it
# connects only where the first stored nothing, and the third reaches into the second
_HELD_CTES = [
    *[
        (f"landing{k}", f"select * from ci_runs where id * 100 >= {low} * (select max(id) from ci_runs) and id * 100 < {high} * (select max(id) from ci_runs)")
        for k, (low, high) in enumerate(LANDINGS)
    ],
    ("stored0", _below_cut("landing0")),
    ("mark0", "select repo_id, max(id) as mark from stored0 group by repo_id"),
    ("free1", "select * from landing1 where repo_id not in (select repo_id from mark0)"),
    ("stored1", _below_cut("free1")),
    ("waits1", "select * from landing1 where repo_id in (select repo_id from mark0)"),
    ("mark1", "select repo_id, max(id) as mark from (select repo_id, id from stored0 union all select repo_id, id from stored1) group by repo_id"),
    ("reached", """select distinct repo_id from landing2 l where not exists (select 1 from mark1 m where m.repo_id = l.repo_id)
    or exists (select 1 from mark1 m where m.repo_id = l.repo_id and m.mark = l.id)"""),
    ("meets", """select repo_id from waits1 group by repo_id having repo_id in (select repo_id from reached)
    and min(id) <= (select max(l.id) from landing2 l where l.repo_id = waits1.repo_id)"""),
    ("taken2", """select * from landing2 where repo_id in (select repo_id from reached)
    union select * from waits1 where repo_id in (select repo_id from meets)"""),
    ("stored2", f"select s.* from ({_below_cut('taken2')}) s left join mark1 m using (repo_id) where m.mark is null or s.id > m.mark"),
]
_HELD = """
select *, null::bigint as waits_since from (from stored0 union all from stored1 union all from stored2)
union all select *, 1 from waits1 where repo_id not in (select repo_id from meets)
union all select *, 2 from landing2 where repo_id not in (select repo_id from reached)"""

_STATES = [
    ("status", "id % 5 <> 0"),
    ("case when id % 7 = 0 then 'queued' else status end", "id % 5 <> 0 or id % 2 = 0"),
    ("case when id % 3 = 0 then 'queued' when id % 7 = 0 then 'in_progress' else status end", "id % 11 <> 0"),
    ("case when id % 7 = 0 then 'queued' else status end", "id % 5 <> 0"),
]
_LOG_CTES = [(f"state{k}", f"select * replace ({status} as status) from ci_runs where {rows}") for k, (status, rows) in enumerate(_STATES)]
# a state's rows that the one before lacks, less the rows that some later state lacks again
_LOG_DIFF = (
    " union ".join(f"(from state{k} except from state{k - 1})" for k in (1, 2, 3))
    + "".join(f" except (from state{k - 1} except from state{k})" for k in (1, 2, 3))
    + " order by id"
)
_LOG_NET = """
select *, 'insert' as change_type from state3 where id not in (select id from state0)
union all select *, 'delete' from state0 where id not in (select id from state3)
union all select *, 'update' from (from state3 except from state0) where id in (select id from state0)"""

ORACLES = {
    "read_json_records": with_views(["ci_repositories"], "select * from ci_repositories"),
    "create_table_as": with_views(["ci_runs"], "select * from ci_runs"),
    "append_records": with_views(["extension_downloads"], "select * from extension_downloads"),
    "copy_tables": with_views(["ci_jobs"], "select * from ci_jobs"),
    "materialize_derived": with_views(BENCH_VIEWS, OK_MEANS.strip()),
    "compact_table": with_views(["extension_downloads"], "select * from extension_downloads"),
    "commit_runs_and_mark": with_views(
        ["ci_runs"], "select *, max(id) over (partition by repo_id) as max_run_id from stored", [("stored", _STORED)]
    ),
    "publish_runs_and_mark": with_views(
        ["ci_runs"],
        "select s.*, m.max_run_id from stored s join (select repo_id, max(id) as max_run_id from stored group by repo_id) m using (repo_id)",
        [("stored", _STORED)],
    ),
    "published_states": with_views(
        BENCH_VIEWS,
        """select run_id, n_means, queries_attempted, queries_failed, s.state
from (select run_id, count(*) as n_means from means group by run_id) join attempts using (run_id)
join runs using (run_id) join (values (1, 'native'), (1, 'lake'), (2, 'native')) as s(state, storage_type) using (storage_type)""",
        [
            ("means", OK_MEANS.strip()),
            ("attempts", """select run_id, count(*) as queries_attempted, count(*) filter (where status <> 'ok') as queries_failed
from query_results group by run_id"""),
        ],
    ),
    "landing_stream": with_views(
        ["ci_runs"], "select *, case when id % 3 = 0 then id % 5 end as run_attempt from stored", [("stored", _STORED)]
    ),
    "held_runs": with_views(["ci_runs"], _HELD, _HELD_CTES),
    "late_period_load": with_views(["extension_downloads"], _WEEKLY),
    "read_download_stats": with_views(["extension_downloads"], f"{_WEEKLY} where repository <> 'core' or year >= 1999"),
    "read_lake_table": with_views(["ci_jobs"], "select * from ci_jobs"),
    "create_typed_table": with_views(
        ["extension_downloads"], "select * from extension_downloads union all select * from extension_downloads"
    ),
    "require_non_empty": with_views(
        ["ci_repositories"],
        "select * from ci_repositories cross join (values ('empty', false), ('full', true), ('missing', true)) as t(name, passes)",
    ),
    "change_log_diff": with_views(["ci_runs"], _LOG_DIFF, _LOG_CTES),
    "change_log_net": with_views(["ci_runs"], _LOG_NET, _LOG_CTES),
    "runs_without_jobs_stored": INGEST_ORACLES["runs_without_jobs"],
    "approximate_baselines": with_views(
        BENCH_VIEWS,
        """select s.benchmark_series, t.query, s.engine_version, count(*) as n_medians, true as within_bound
from labelled s join (select run_id, query from query_metrics m where """ + TIMING + """ group by all) t using (run_id)
join query_results q on q.run_id = t.run_id and q.query = t.query
where s.storage_type = 'native' and s.engine_version in (""" + ", ".join(f"'{v}'" for v in NATIVE.pinned_versions) + """)
group by all""",
        [("labelled", LABELS)],
    ),
    "run_labels": with_views(
        BENCH_VIEWS,
        "select run_id, run_date, scale_factor_label, benchmark_series, cpu_arch_label, machine_label from labelled",
        [("labelled", LABELS)],
    ),
}
