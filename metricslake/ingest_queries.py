"""Registered ingestion scenarios over the test tables, with their DuckDB oracles.

The CI tables are built by the adapters; stored state is derived from them by
date, so every scenario grows with the tables:

* marks      = per repository, the largest run id created before a cutoff;
* snapshot T = the runs created up to T, a run still updating after T shown as
  'in_progress' (the table as a feed would have stored it at time T).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake.operators import changes, ingest
from metricslake.session import configure
from metricslake.sources import download_files as dl
from metricslake.sources.adapters import model_table, with_views

MARK_CUTOFF = dt.datetime(1995, 1, 15)
AS_OF = dt.datetime(2001, 8, 2)
GATE_MARK_FROM, GATE_MARK_TO = dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1)
GATE_BATCH_FROM = dt.datetime(1997, 7, 1)
REF_FROM, REF_TO = dt.datetime(1999, 1, 1), dt.datetime(2000, 1, 1)
JOBS_AS_OF = dt.datetime(2000, 1, 1)
BUDGET_REMAINING = 100
MAIN_REPO = "org/nation_3"
SNAP_BEFORE, SNAP_AFTER = dt.datetime(1998, 1, 1), dt.datetime(1999, 1, 1)
FETCH_FROM = dt.datetime(1997, 12, 20)


def _ts(v: dt.datetime):
    return F.lit(v).cast("timestamp_ntz")


def _runs(spark, sf_dir) -> DataFrame:
    configure(spark)
    return model_table(spark, sf_dir, "ci_runs")


def _flat(runs: DataFrame) -> DataFrame:
    return runs.select(
        "id", "status", "event", "created_at", "updated_at",
        F.col("repository.id").alias("repo_id"), F.col("repository.full_name").alias("repo"),
    )


def marks_before(runs: DataFrame, cutoff: dt.datetime, start: dt.datetime | None = None) -> DataFrame:
    cond = F.col("created_at") < _ts(cutoff)
    if start is not None:
        cond &= F.col("created_at") >= _ts(start)
    return runs.where(cond).groupBy(F.col("repository.id").alias("repository_id")).agg(
        F.max("id").alias("max_run_id")
    )


def snapshot(runs: DataFrame, at: dt.datetime) -> DataFrame:
    flat = _flat(runs).where(F.col("created_at") <= _ts(at))
    return flat.withColumn(
        "status", F.when(F.col("updated_at") > _ts(at), F.lit("in_progress")).otherwise(F.col("status"))
    )


def q_completed_prefix(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    kept = ingest.completed_prefix(runs, marks_before(runs, MARK_CUTOFF), AS_OF)
    return _flat(kept).select("id", "status", "created_at", "updated_at", "repo_id")


def q_new_high_water_mark(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return ingest.new_high_water_mark(
        ingest.completed_prefix(runs, marks_before(runs, MARK_CUTOFF), AS_OF)
    )


def q_stored_preview(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    kept = ingest.completed_prefix(runs, marks_before(runs, MARK_CUTOFF), AS_OF)
    return ingest.stored_preview(kept, ["id", "created_at", "status", "html_url"])


def q_repo_high_water_marks(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    repos = model_table(spark, sf_dir, "ci_repositories")
    return ingest.repo_high_water_marks(repos, marks_before(runs, MARK_CUTOFF))


def _gate(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    marks = marks_before(runs, GATE_MARK_TO, GATE_MARK_FROM)
    batch = runs.where(F.col("created_at") >= _ts(GATE_BATCH_FROM))
    return ingest.contiguity_gate(batch, marks)


def q_contiguity_gate(spark, sf_dir):
    return _gate(spark, sf_dir).accepted.select("id", F.col("repository.id").alias("repo_id"))


def q_contiguity_rejected(spark, sf_dir):
    return _gate(spark, sf_dir).rejected


def _ref_cut(spark, sf_dir, shift):
    runs = _flat(_runs(spark, sf_dir))
    refs = (
        runs.where((F.col("created_at") >= _ts(REF_FROM)) & (F.col("created_at") < _ts(REF_TO)))
        .groupBy("repo_id")
        .agg((F.min("id") + shift).alias("ref"))
    )
    return ingest.reference_id_cut(runs.select("id", "repo_id"), refs, "repo_id")


def q_reference_id_cut(spark, sf_dir):
    return _ref_cut(spark, sf_dir, 0).kept


def q_reference_id_invalid(spark, sf_dir):
    # one past the smallest id: usually not an id of the same repository
    return _ref_cut(spark, sf_dir, 1).invalid


def _work(spark, sf_dir, as_of=JOBS_AS_OF, max_age_days=ingest.JOB_CUTOFF_DAYS):
    runs = _runs(spark, sf_dir)
    jobs = model_table(spark, sf_dir, "ci_jobs")
    return ingest.runs_without_jobs(runs, jobs, as_of, max_age_days)


def q_runs_without_jobs(spark, sf_dir):
    return _work(spark, sf_dir)


def q_run_ids_per_repo(spark, sf_dir):
    repos = model_table(spark, sf_dir, "ci_repositories")
    return ingest.run_ids_per_repo(repos, _work(spark, sf_dir, max_age_days=None))


def q_budgeted_work(spark, sf_dir):
    repos = model_table(spark, sf_dir, "ci_repositories")
    per_repo = ingest.run_ids_per_repo(repos, _work(spark, sf_dir, max_age_days=None))
    return ingest.budgeted_work(per_repo, repos.select("full_name"), BUDGET_REMAINING, MAIN_REPO)


def q_tag_with_repository(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    jobs = model_table(spark, sf_dir, "ci_jobs")
    workflows = (
        jobs.join(runs.select(F.col("id").alias("run_id"), "repository"), "run_id")
        .select(F.col("workflow_name").alias("name"), F.col("repository.full_name").alias("_repo"))
        .distinct()
    )
    valid, _ = ingest.tag_with_repository(workflows, "_repo")
    return valid.select("name", "repository")


def _snapshots(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return snapshot(runs, SNAP_BEFORE), snapshot(runs, SNAP_AFTER)


def q_changed_rows(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    return changes.changed_rows(after.where(F.col("created_at") >= _ts(FETCH_FROM)), before)


def q_upsert_changed(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    batch = after.where(F.col("created_at") >= _ts(FETCH_FROM))
    return changes.upsert_changed(before, batch, ["id"])


def q_upsert_high_water_mark(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    old = marks_before(runs, SNAP_BEFORE)
    new = marks_before(runs, SNAP_AFTER, SNAP_BEFORE)
    return changes.upsert_high_water_mark(old, new)


def q_snapshot_diff(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    return changes.snapshot_diff(before, after)


def q_snapshot_changes(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    # the later snapshot also loses the runs of one event type (deletes)
    after = after.where(F.col("event") != "5-LOW")
    return changes.snapshot_changes(before, after, ["id"])


def q_column_profile(spark, sf_dir):
    configure(spark)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return changes.column_profile(li)


def q_column_profile_stored(spark, sf_dir):
    return changes.stored_profile(configure(spark), f"{sf_dir}/lineitem.parquet")


def _downloads(spark, sf_dir):
    configure(spark)
    return model_table(spark, sf_dir, "extension_downloads")


def _files(spark, sf_dir) -> DataFrame:
    # The weekly files are materialized, as a producer would write them, in the
    # shared checkpoint folder; without the cut Catalyst would push the path parsing
    # through the aggregates and run it on every source row instead of once per file.
    return dl.download_files_from_table(_downloads(spark, sf_dir)).checkpoint(eager=True)


def q_parse_period_path(spark, sf_dir):
    files = _files(spark, sf_dir)
    return dl.parse_period_path(files).valid.select("repository", "file_path", "year", "week")


def q_unpivot_download_counts(spark, sf_dir):
    files = _files(spark, sf_dir)
    return dl.unpivot_download_counts(dl.parse_period_path(files).valid).valid


def _stored(d: DataFrame) -> DataFrame:
    return d.where((F.col("repository") == "core") & (F.col("year") < 1999))


def q_skip_stored_periods(spark, sf_dir):
    d = _downloads(spark, sf_dir)
    return dl.skip_stored_periods(d, _stored(d))


def q_skip_stored_periods_legacy(spark, sf_dir):
    d = _downloads(spark, sf_dir)
    return dl.skip_stored_periods(d, _stored(d), legacy_key=True)


QUERIES = {
    "completed_prefix": q_completed_prefix,
    "new_high_water_mark": q_new_high_water_mark,
    "stored_preview": q_stored_preview,
    "repo_high_water_marks": q_repo_high_water_marks,
    "contiguity_gate": q_contiguity_gate,
    "contiguity_rejected": q_contiguity_rejected,
    "reference_id_cut": q_reference_id_cut,
    "reference_id_invalid": q_reference_id_invalid,
    "runs_without_jobs": q_runs_without_jobs,
    "run_ids_per_repo": q_run_ids_per_repo,
    "budgeted_work": q_budgeted_work,
    "tag_with_repository": q_tag_with_repository,
    "changed_rows": q_changed_rows,
    "upsert_changed": q_upsert_changed,
    "upsert_high_water_mark": q_upsert_high_water_mark,
    "snapshot_diff": q_snapshot_diff,
    "snapshot_changes": q_snapshot_changes,
    "column_profile": q_column_profile,
    "column_profile_stored": q_column_profile_stored,
    "parse_period_path": q_parse_period_path,
    "unpivot_download_counts": q_unpivot_download_counts,
    "skip_stored_periods": q_skip_stored_periods,
    "skip_stored_periods_legacy": q_skip_stored_periods_legacy,
}

# ---- DuckDB oracles ------------------------------------------------------------------


def _t(v: dt.datetime) -> str:
    return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"


def _marks_sql(cutoff, start=None) -> str:
    cond = f"created_at < {_t(cutoff)}" + (f" and created_at >= {_t(start)}" if start else "")
    return f"select repo_id as repository_id, max(id) as max_run_id from ci_runs where {cond} group by repo_id"


_STALE = AS_OF - dt.timedelta(hours=ingest.STALE_HOURS)
_KEPT = f"""
select r.* from ci_runs r
left join (select repo_id, min(id) filter (where status <> 'completed' and updated_at > {_t(_STALE)}) as cut
           from ci_runs group by repo_id) c on c.repo_id = r.repo_id
left join marks m on m.repository_id = r.repo_id
where (c.cut is null or r.id < c.cut) and (m.max_run_id is null or r.id > m.max_run_id)"""

_CI = ["ci_repositories", "ci_runs", "ci_jobs"]


def _ci(body: str, ctes: list[tuple[str, str]] | None = None) -> str:
    return with_views(_CI, body, ctes)


_PREFIX = [("marks", _marks_sql(MARK_CUTOFF)), ("kept", _KEPT)]

_GATE = [
    ("marks", _marks_sql(GATE_MARK_TO, GATE_MARK_FROM)),
    ("batch", f"select id, repo_id from ci_runs where created_at >= {_t(GATE_BATCH_FROM)}"),
    (
        "per_repo",
        """select b.repo_id, any_value(m.max_run_id) as mark, bool_or(b.id = m.max_run_id) as reached
  from batch b left join marks m on m.repository_id = b.repo_id group by b.repo_id""",
    ),
]

def _ref_ctes(shift: int):
    return [
        (
            "refs",
            f"""select repo_id, min(id) + {shift} as ref from ci_runs
  where created_at >= {_t(REF_FROM)} and created_at < {_t(REF_TO)} group by repo_id""",
        ),
        ("stats", "select repo_id, min(id) as lo, max(id) as hi from ci_runs group by repo_id"),
        (
            "present",
            "select distinct r.repo_id from ci_runs r join refs f on f.repo_id = r.repo_id where r.id = f.ref",
        ),
        (
            "invalid",
            """select s.repo_id from stats s join refs f on f.repo_id = s.repo_id
  where f.ref <> 0 and s.lo < f.ref and f.ref < s.hi
    and s.repo_id not in (select repo_id from present)""",
        ),
    ]


_JOBS_SINCE = JOBS_AS_OF - dt.timedelta(days=ingest.JOB_CUTOFF_DAYS)


def _work_sql(since: dt.datetime | None) -> str:
    cond = "c.status = 'completed'" + (f" and c.updated_at > {_t(since)}" if since else "")
    return f"""select c.repo_id, c.id as run_id from ci_runs c
  where {cond} and not exists (select 1 from ci_jobs j where j.run_id = c.id)"""


def _snap_sql(at: dt.datetime) -> str:
    return f"""select id, case when updated_at > {_t(at)} then 'in_progress' else status end as status,
  event, created_at, updated_at, repo_id, repo from ci_runs where created_at <= {_t(at)}"""


_SNAPS = [("before", _snap_sql(SNAP_BEFORE)), ("after", _snap_sql(SNAP_AFTER))]
_CHANGED = f"select * from after where created_at >= {_t(FETCH_FROM)} except select * from before"


def _profile_sql() -> str:
    parts = []
    doubles = "l_quantity l_extendedprice l_discount l_tax".split()
    others = "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus l_shipdate".split()
    for c in doubles + others:
        nan = f"coalesce(bool_or(isnan({c})), false)" if c in doubles else "false"
        parts.append(
            f"select '{c}' as column_name, cast(min({c}) as varchar) as min_value, "
            f"cast(max({c}) as varchar) as max_value, {nan} as contains_nan, "
            f"count(*) filter (where {c} is null) as null_count from lineitem"
        )
    return "\nunion all\n".join(parts)


_DL = ["extension_downloads"]
_STORED = "select * from extension_downloads where repository = 'core' and year < 1999"

ORACLES = {
    "completed_prefix": _ci(
        "select id, status, created_at, updated_at, repo_id from kept", _PREFIX
    ),
    "new_high_water_mark": _ci(
        "select repo_id as repository_id, max(id) as max_run_id from kept group by repo_id", _PREFIX
    ),
    "stored_preview": _ci("select id, created_at, status, html_url from kept order by id", _PREFIX),
    "repo_high_water_marks": _ci(
        """select r.full_name, r.id,
  (select k.max_run_id from marks k where k.repository_id = r.id) as max_run_id
from ci_repositories r""",
        [("marks", _marks_sql(MARK_CUTOFF))],
    ),
    "contiguity_gate": _ci(
        """select b.id, b.repo_id from batch b
where b.repo_id in (select repo_id from per_repo where mark is null or coalesce(reached, false))""",
        _GATE,
    ),
    "contiguity_rejected": _ci(
        "select repo_id as repository_id from per_repo where not (mark is null or coalesce(reached, false))",
        _GATE,
    ),
    "reference_id_cut": _ci(
        """select r.id, r.repo_id from ci_runs r left join refs f on f.repo_id = r.repo_id
where (f.ref is null or f.ref = 0 or r.id >= f.ref)
  and r.repo_id not in (select repo_id from invalid)""",
        _ref_ctes(0),
    ),
    "reference_id_invalid": _ci("select repo_id from invalid", _ref_ctes(1)),
    "runs_without_jobs": _ci(_work_sql(_JOBS_SINCE)),
    "run_ids_per_repo": _ci(
        """select r.full_name, w.run_id from work w join ci_repositories r on r.id = w.repo_id
union all
select r.full_name, null from ci_repositories r
where r.id not in (select repo_id from work)""",
        [("work", _work_sql(None))],
    ),
    "budgeted_work": _ci(
        f"""select full_name, run_id from (
  select r.full_name, w.run_id,
    row_number() over (partition by r.full_name order by w.run_id) as rn
  from ci_repositories r join work w on w.repo_id = r.id) x, budget_split b
where rn <= case when full_name = '{MAIN_REPO}' then b.main else b.other end
order by full_name, run_id""",
        [
            ("work", _work_sql(None)),
            (
                "counts",
                f"""select count(*) as n, count(*) filter (where full_name = '{MAIN_REPO}') > 0 as has_main,
  floor({BUDGET_REMAINING} * {ingest.BUDGET_SHARE})::bigint as total from ci_repositories""",
            ),
            (
                "budgets",
                f"""select case when not has_main then 0
    when n - 1 > 0 then floor(total * {ingest.MAIN_REPO_SHARE})::bigint else total end as main,
  n - case when has_main then 1 else 0 end as others, total from counts""",
            ),
            (
                "budget_split",
                "select main, case when others > 0 then floor((total - main) / others)::bigint else 0 end as other from budgets",
            ),
        ],
    ),
    "tag_with_repository": _ci(
        """select distinct j.workflow_name as name, r.repo as repository
from ci_jobs j join ci_runs r on j.run_id = r.id
where regexp_full_match(r.repo, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+')"""
    ),
    "changed_rows": _ci(_CHANGED, _SNAPS),
    "upsert_changed": _ci(
        """select * from before where id not in (select id from changed)
union all select * from changed""",
        _SNAPS + [("changed", _CHANGED)],
    ),
    "upsert_high_water_mark": _ci(
        """select * from old where repository_id not in (select repository_id from changed)
union all select * from changed""",
        [
            ("old", _marks_sql(SNAP_BEFORE)),
            ("new", _marks_sql(SNAP_AFTER, SNAP_BEFORE)),
            ("changed", "select * from new except select * from old"),
        ],
    ),
    "snapshot_diff": _ci("select * from after except select * from before order by id", _SNAPS),
    "snapshot_changes": _ci(
        """select coalesce(a.id, b.id) as id,
  case when b.id is null then 'insert' when a.id is null then 'delete' else 'update' end as change_type,
  coalesce(a.status, b.status) as status, coalesce(a.event, b.event) as event,
  coalesce(a.created_at, b.created_at) as created_at, coalesce(a.updated_at, b.updated_at) as updated_at,
  coalesce(a.repo_id, b.repo_id) as repo_id, coalesce(a.repo, b.repo) as repo
from before b full outer join after2 a on a.id = b.id
where b.id is null or a.id is null
   or (a.status, a.event, a.created_at, a.updated_at, a.repo_id, a.repo)
      is distinct from (b.status, b.event, b.created_at, b.updated_at, b.repo_id, b.repo)""",
        _SNAPS + [("after2", "select * from after where event <> '5-LOW'")],
    ),
    "column_profile": _profile_sql(),
    "column_profile_stored": _profile_sql(),
    "parse_period_path": with_views(
        _DL,
        """select repository,
  'lake/' || repository || '/download-stats-weekly/' || year || '/' || week || '.json' as file_path,
  year, week
from (select distinct year, week, repository from extension_downloads)""",
    ),
    "unpivot_download_counts": with_views(
        _DL,
        """select year, week, extension_name, downloads,
  max(last_update) over (partition by year, week, repository) as last_update, repository
from extension_downloads""",
    ),
    "skip_stored_periods": with_views(
        _DL,
        "select * from extension_downloads anti join stored using (year, week, repository)",
        [("stored", _STORED)],
    ),
    "skip_stored_periods_legacy": with_views(
        _DL,
        "select * from extension_downloads anti join stored using (year, week)",
        [("stored", _STORED)],
    ),
}
