"""Incremental CI ingestion as one distributed pass over all repositories.

The source model walks repositories one by one; here each operator takes the
landed batch of every repository at once and works per repository with
grouping and joins keyed by the repository id. Per-repository tables (marks,
cuts, verdicts of the gate) have one row per repository. They are written first, so the planner
knows their size: it broadcasts them while they are small, and the runs themselves are filtered
where they are read, however many of them one repository holds.

Repository ids are read from the run's ``repository`` struct (``repository.id``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricslake import fixed as fx
from metricslake.sources.lake import known_size

REPO_NAME_PATTERN = fx.REPO_NAME_PATTERN  # 'org/name'
STALE_HOURS = fx.STALE_HOURS  # an unfinished run older than this no longer holds back newer runs
JOB_CUTOFF_DAYS = fx.JOB_CUTOFF_DAYS  # jobs are sought for runs updated within this many days
BUDGET_SHARE = fx.BUDGET_SHARE  # share of the remaining API budget a feed run may use
MAIN_REPO_SHARE = fx.MAIN_REPO_SHARE  # share of that budget for the main repository


def _ts(value: dt.datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def repo_id_col(runs: DataFrame) -> Column:
    return F.col("repository.id") if "repository" in runs.columns else F.col("repo_id")


# ---- repositories and workflows --------------------------------------------------


def tag_with_repository(workflows: DataFrame, repo: Column | str) -> tuple[DataFrame, DataFrame]:
    """Add the repository name to each workflow; (valid, rejected) by name pattern."""
    tagged = workflows.withColumn("repository", F.col(repo) if isinstance(repo, str) else repo)
    ok = F.coalesce(F.col("repository").rlike(REPO_NAME_PATTERN), F.lit(False))
    return tagged.where(ok), tagged.where(~ok)


def repo_high_water_marks(repos: DataFrame, marks: DataFrame) -> DataFrame:
    """Every repository with its stored max run id (NULL when none), by name."""
    m = marks.select(F.col("repository_id").alias("id"), "max_run_id")
    return (
        repos.select("full_name", "id")
        .join(m, "id", "left")
        .select("full_name", "id", "max_run_id")
        .orderBy(F.col("full_name").asc_nulls_last())
    )


# ---- run batches -------------------------------------------------------------------


def newest_copies(runs: DataFrame) -> DataFrame:
    """One row per run id: the copy updated last (a completed one of equal copies).

    Landings overlap, since each reaches back to the stored mark; tasks keep one copy of
    an id before the shuffle.
    """
    newest = Window.partitionBy("id").orderBy(
        F.col("updated_at").desc_nulls_last(), (F.col("status") == "completed").desc_nulls_last()
    )
    return runs.withColumn("_copy", F.row_number().over(newest)).where(F.col("_copy") == 1).drop("_copy")


def completed_prefix(
    runs: DataFrame,
    marks: DataFrame,
    as_of: dt.datetime,
    stale_hours: int | None = STALE_HOURS,
) -> DataFrame:
    """Runs that may be stored now, per repository, in one pass.

    cut  = smallest id of a run that is not completed and was updated within
           ``stale_hours`` before ``as_of`` (no age limit when ``stale_hours`` is None);
    keep = id < cut (when there is a cut) and id > stored mark (when there is one).

    A stale unfinished run below the cut is kept with its unfinished status, so one
    stuck run cannot block a repository forever. Marks and cuts are NULL-aware: an
    id of 0 is a real id, not "no value".
    """
    rid = repo_id_col(runs)
    blocking = F.col("status") != "completed"
    if stale_hours is not None:
        blocking &= F.col("updated_at") > _ts(as_of - dt.timedelta(hours=stale_hours))
    none = F.lit(None).cast("long")
    own = runs.where(blocking).select(rid.alias("_rid"), F.col("id").alias("_cut"), none.alias("_mark"))
    stored = marks.select(F.col("repository_id").alias("_rid"), none.alias("_cut"), F.col("max_run_id").alias("_mark"))
    # one row for each repository that has a bound; runs meet it where they are read
    limits = own.union(stored).groupBy("_rid").agg(F.min("_cut").alias("_cut"), F.max("_mark").alias("_mark"))
    j = runs.withColumn("_rid", rid).join(known_size(limits, "limits"), "_rid", "left")
    keep = (F.col("_cut").isNull() | (F.col("id") < F.col("_cut"))) & (
        F.col("_mark").isNull() | (F.col("id") > F.col("_mark"))
    )
    return j.where(keep).select(*runs.columns)


def new_high_water_mark(kept: DataFrame) -> DataFrame:
    """(repository_id, max_run_id) of the rows about to be stored."""
    return kept.groupBy(repo_id_col(kept).alias("repository_id")).agg(
        F.max("id").alias("max_run_id")
    )


@dataclass(frozen=True)
class GateResult:
    accepted: DataFrame  # rows of accepted repositories
    rejected: DataFrame  # repository ids to fetch again (nothing of theirs stored)


def contiguity_gate(
    batch: DataFrame, marks: DataFrame, exhausted: DataFrame | None = None
) -> GateResult:
    """Accept a repository's landed runs only if they connect to what is stored.

    Accepted when the repository has no mark, when the batch contains the marked
    run id (the fetch reached back to it), or when the repository is listed in
    ``exhausted`` (the listing reached the oldest run). Otherwise nothing of that
    repository is stored, so no gap can appear, and it is reported for a retry.
    """
    rid = repo_id_col(batch)
    ids = batch.select(rid.alias("_rid"), F.col("id"))
    m = known_size(marks.select(F.col("repository_id").alias("_rid"), F.col("max_run_id").alias("_mark")), "marks")
    per_repo = ids.join(m, "_rid", "left").groupBy("_rid").agg(
        F.max("_mark").alias("_mark"),  # one mark per repository
        F.bool_or(F.col("id") == F.col("_mark")).alias("_reached"),
    )
    ok = F.col("_mark").isNull() | F.coalesce(F.col("_reached"), F.lit(False))
    if exhausted is not None:
        done = exhausted.select(F.col("repository_id").alias("_rid"), F.lit(True).alias("_done"))
        per_repo = per_repo.join(done, "_rid", "left")
        ok = ok | F.coalesce(F.col("_done"), F.lit(False))
    verdict = known_size(per_repo.select("_rid", ok.alias("_ok")), "verdict")
    accepted_ids = verdict.where("_ok").select("_rid")
    accepted = batch.withColumn("_rid", rid).join(accepted_ids, "_rid", "left_semi").select(*batch.columns)
    rejected = verdict.where(~F.col("_ok")).select(F.col("_rid").alias("repository_id"))
    return GateResult(accepted, rejected)


@dataclass(frozen=True)
class Connected:
    accepted: DataFrame  # rows of landings that connect to what is stored
    held: DataFrame  # rows of the others
    landings: DataFrame  # (repository_id, landing, connected): one row for each


def connect_landings(rows: DataFrame, marks: DataFrame, landing_col: str, exhausted: DataFrame | None = None) -> Connected:
    """The contiguity gate over several landings of each repository at once.

    A landing lists a repository's runs without a gap, from its smallest id to its largest.
    Landings that overlap list theirs without a gap together; such a chain connects to what
    is stored if one of its landings holds the marked run id. So a landing that was held back
    because it did not reach the mark is accepted as soon as later ones close the gap,
    without being fetched again. Repositories without a mark, and chains with a landing in
    ``exhausted`` (``repository_id`` and the landing: its listing reached the oldest run), are
    accepted as they are.
    """
    rid = repo_id_col(rows)
    tagged = rows.withColumn("_rid", rid)
    m = known_size(marks.select(F.col("repository_id").alias("_rid"), F.col("max_run_id").alias("_mark")), "marks")
    spans = (
        tagged.select("_rid", F.col(landing_col).alias("_landing"), "id")
        .join(m, "_rid", "left")
        .groupBy("_rid", "_landing")
        .agg(
            F.min("id").alias("_lo"),
            F.max("id").alias("_hi"),
            F.max("_mark").alias("_mark"),
            F.coalesce(F.bool_or(F.col("id") == F.col("_mark")), F.lit(False)).alias("_reached"),
        )
    )
    if exhausted is not None:
        done = exhausted.select(F.col("repository_id").alias("_rid"), F.col(landing_col).alias("_landing"), F.lit(True).alias("_done"))
        spans = spans.join(done, ["_rid", "_landing"], "left").withColumn("_reached", F.col("_reached") | F.coalesce("_done", F.lit(False)))
    # a chain begins where a landing starts above everything listed by those before it
    ordered = Window.partitionBy("_rid").orderBy("_lo", "_landing")
    before = F.max("_hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    chained = spans.withColumn("_begins", F.when(before.isNull() | (F.col("_lo") > before), 1).otherwise(0))
    chained = chained.withColumn("_chain", F.sum("_begins").over(ordered))
    reached = F.col("_mark").isNull() | F.max("_reached").over(Window.partitionBy("_rid", "_chain"))
    verdict = known_size(chained.select("_rid", "_landing", reached.alias("_ok")), "landings")

    def having(ok: Column) -> DataFrame:
        chosen = verdict.where(ok).select("_rid", F.col("_landing").alias(landing_col))
        return tagged.join(chosen, ["_rid", landing_col], "left_semi").select(*rows.columns)

    told = verdict.select(F.col("_rid").alias("repository_id"), F.col("_landing").alias("landing"), F.col("_ok").alias("connected"))
    return Connected(having(F.col("_ok")), having(~F.col("_ok")), told)


@dataclass(frozen=True)
class CutResult:
    kept: DataFrame
    invalid: DataFrame  # groups whose reference id lies inside their id range but is absent


def reference_id_cut(
    records: DataFrame,
    refs: DataFrame,
    key: str,
    fetch_smaller: bool = False,
    strict: bool = False,
) -> CutResult:
    """Keep ids >= ref per group (<= ref when ``fetch_smaller``); ref 0 keeps all.

    ``refs`` has columns (key, ref). When a group's ref lies strictly inside its id
    range it must be one of the ids; such groups are returned as ``invalid`` and
    their rows are not kept (``strict`` raises instead).
    """
    r = known_size(refs.select(key, F.col("ref").alias("_ref")), "refs")
    # one aggregate per group: id range and whether the reference id is among the ids
    stats = records.select(key, "id").join(r, key, "left").groupBy(key).agg(
        F.min("id").alias("_lo"),
        F.max("id").alias("_hi"),
        F.max("_ref").alias("_ref"),  # one reference id per group
        F.bool_or(F.col("id") == F.col("_ref")).alias("_present"),
    )
    missing = (
        (F.col("_ref") != 0)
        & (F.col("_lo") < F.col("_ref"))
        & (F.col("_ref") < F.col("_hi"))
        & ~F.coalesce(F.col("_present"), F.lit(False))
    )
    groups = known_size(stats.select(key, "_ref", F.coalesce(missing, F.lit(False)).alias("_missing")), "groups")
    check = groups.where("_missing").select(key)
    if strict:
        bad = check.limit(1).collect()
        if bad:
            raise ValueError(f"reference id not found for {key}={bad[0][0]}")
    cond = F.col("_ref").isNull() | (F.col("_ref") == 0)
    cond |= (F.col("id") <= F.col("_ref")) if fetch_smaller else (F.col("id") >= F.col("_ref"))
    kept = records.join(groups.where(~F.col("_missing")).withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).where(cond)
    return CutResult(kept.select(*[records[c] for c in records.columns]), check)


# ---- jobs --------------------------------------------------------------------------


#: Partition column of stored jobs: the first day of the month in which their run was created.
RUN_MONTH = "run_month"


def _month(created_at: Column) -> Column:
    return F.trunc(created_at.cast("date"), "month")


def with_run_month(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs with RUN_MONTH, which never changes for a run; null if the run is not among ``runs``.

    Only the runs of these jobs meet them, as a side of known size: a run with very many jobs is not
    moved while that side is small.
    """
    ids = jobs.select("run_id").distinct()
    of_jobs = runs.select(F.col("id").alias("run_id"), _month(F.col("created_at")).alias(RUN_MONTH)).join(ids, "run_id", "left_semi")
    months = known_size(of_jobs.groupBy("run_id").agg(F.min(RUN_MONTH).alias(RUN_MONTH)), "run_months")
    return jobs.join(months, "run_id", "left").select(*jobs.columns, RUN_MONTH)


def runs_without_jobs(
    runs: DataFrame,
    jobs: DataFrame,
    as_of: dt.datetime,
    max_age_days: int | None = JOB_CUTOFF_DAYS,
) -> DataFrame:
    """(repo_id, run_id) of completed, recently updated runs with no job row, by run id.

    Of jobs stored by the month of their run (:func:`with_run_month`) only the partitions from the oldest
    of these runs on are read, and the one of jobs whose run was not known.
    """
    cond = F.col("status") == "completed"
    if max_age_days is not None:
        cond &= F.col("updated_at") > _ts(as_of - dt.timedelta(days=max_age_days))
    r = runs.where(cond).select(repo_id_col(runs).alias("repo_id"), F.col("id").alias("run_id"))
    # distinct run ids first: a run with very many jobs collapses to one row per task
    # in the partial aggregate instead of loading one side of the anti join
    if RUN_MONTH in jobs.columns:
        oldest = runs.where(cond).agg(F.min(_month(F.col("created_at")))).scalar()
        jobs = jobs.where(F.col(RUN_MONTH).isNull() | (F.col(RUN_MONTH) >= oldest))
    with_jobs = jobs.select("run_id").distinct()
    return (
        r.join(with_jobs, "run_id", "left_anti")
        .select("repo_id", "run_id")
        .orderBy(F.col("run_id").asc_nulls_last())
    )


def run_ids_per_repo(repos: DataFrame, work: DataFrame) -> DataFrame:
    """Every repository with its outstanding run ids as rows, in id order.

    The source model builds one list per repository; rows carry the same mapping
    (a repository without work has one row with a NULL run id) and never gather
    a large repository into a single value.
    """
    names = repos.select("full_name", "id")
    # the same rows as repos LEFT JOIN work, without shuffling the work by repository
    # (a hot repository would be one task on the side a left join cannot split):
    # work meets the small repository list, idle repositories come from an anti join
    busy = work.select(F.col("repo_id").alias("id"), "run_id").join(names, "id")
    idle = names.join(work.select(F.col("repo_id").alias("id")).distinct(), "id", "left_anti")
    return (
        busy.select("full_name", "run_id")
        .unionByName(idle.select("full_name", F.lit(None).cast("long").alias("run_id")))
        .orderBy(F.col("full_name").asc_nulls_last(), F.col("run_id").asc_nulls_last())
    )


def budget_pool(remaining: int, share: float = BUDGET_SHARE) -> int:
    """The part of the remaining API calls that one feed run may use."""
    return int(remaining * share)


def repo_budgets(
    repos: DataFrame, remaining: int, main_repo: str, share: float = BUDGET_SHARE
) -> DataFrame:
    """(full_name, budget) per repository: the main one gets its share of the pool, or all of
    it when it is the only one; what is left is divided evenly. Shares are rounded down."""
    pool = F.lit(budget_pool(remaining, share))
    is_main = F.col("full_name") == main_repo
    # scalar subqueries over the repository list
    mains, rest = repos.agg(F.count_if(is_main)).scalar(), repos.agg(F.count_if(~is_main)).scalar()
    main = F.when(mains == 0, 0).when(rest == 0, pool).otherwise(F.floor(pool * MAIN_REPO_SHARE))
    even = F.floor((pool - main) / F.when(rest > 0, rest))
    return repos.select("full_name", F.when(is_main, main).otherwise(even).cast("long").alias("budget"))


def budgeted_work(
    work_per_repo: DataFrame, repos: DataFrame, remaining: int, main_repo: str
) -> DataFrame:
    """The first ``budget(repo)`` outstanding run ids of every repository, in id order."""
    work = work_per_repo.where(F.col("run_id").isNotNull()).select("full_name", "run_id")
    pool = budget_pool(remaining)
    # the literal cut comes first, on the work alone; budgets meet what is left of it
    first = Window.partitionBy("full_name").orderBy(F.col("run_id").asc())
    near = work.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= pool)
    return (
        near.join(repo_budgets(repos, remaining, main_repo), "full_name")
        .where(F.col("_r") <= F.col("budget"))
        .select("full_name", "run_id")
        .orderBy(F.col("full_name").asc_nulls_last(), F.col("run_id").asc_nulls_last())
    )


def stored_preview(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Selected columns of newly stored rows, by id."""
    return rows.select(*columns).orderBy(F.col("id").asc_nulls_last())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
