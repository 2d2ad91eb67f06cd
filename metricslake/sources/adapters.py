"""Model tables derived from the TPC-H-like test tables.

Each builder reads the parquet test tables (column pruning and filter pushdown
reach the scan) and shapes them into a model table of ``metricslake.schemas``.
``ORACLE_VIEWS`` holds the same views as DuckDB SQL, used by the correctness
oracle; the two are kept next to each other so they change together.

Dimension joins: ``nation`` has 25 rows by definition of the data set, so it is
broadcast explicitly; every other join is left to the planner (size-checked
broadcast via ``autoBroadcastJoinThreshold`` / AQE runtime statistics,
sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricslake.sources.tables import read_table

EXEC_METRIC = "execution_time_seconds"


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    prio, key, cust = F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey")
    storage = F.when(F.col("o_orderstatus") == "F", "native").otherwise("lake")
    version = (
        F.when(cust % 5 == 0, "v1.4.5").when(cust % 5 == 1, "v1.5.5").otherwise("v2.0.0-alpha")
    )
    benchmark = (
        F.when(prio.isin("1-URGENT", "2-HIGH"), "tpch")
        .when(prio.isin("3-MEDIUM", "5-LOW"), "tpcds")
        .otherwise("clickbench")
    )
    return o.select(
        key.cast("string").alias("run_id"),
        cust.alias("invocation_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("run_ts"),
        F.when(key % 10 == 0, F.lit(True))
        .when(key % 10 == 1, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
        .alias("is_test"),
        benchmark.alias("benchmark"),
        F.concat(storage, F.when(cust % 2 == 0, F.lit("")).otherwise(F.lit("-local"))).alias(
            "benchmark_name"
        ),
        F.when(prio == "4-NOT SPECIFIED", F.lit(None).cast("double"))
        .when(cust % 3 == 0, F.lit(1.0))
        .when(cust % 3 == 1, F.lit(10.0))
        .otherwise(F.lit(100.0))
        .alias("scale_factor"),
        version.alias("engine_version"),
        F.md5(key.cast("string")).alias("engine_commit_sha"),
        F.when(version.like("%alpha%"), "nightly").otherwise("release").alias("binary_source"),
        F.lit("linux").alias("os"),
        F.when(key % 4 == 0, F.lit(None).cast("string"))
        .when(key % 4 == 1, F.lit("arm64"))
        .otherwise(F.lit("x86_64"))
        .alias("cpu_arch"),
        F.when(key % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("m1")).alias("machine_type"),
        ((cust % 4 + 1) * 4).cast("int").alias("threads"),
        F.lit("16GB").alias("memory_limit"),
        storage.alias("storage_type"),
        F.lit(5).alias("warm_runs"),
        F.md5(benchmark).alias("queries_sha"),
    )


def bench_query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    # min(flag) = 'R'  <=>  no flag below 'R' and some flag equal to 'R' (max alike):
    # boolean buffers keep this a hash aggregate; a string min/max would sort every row
    g = li.groupBy(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("query")).agg(
        (F.bool_and(rf >= "R") & F.bool_or(rf == "R")).alias("_failed"),
        (F.bool_and(ls <= "O") & F.bool_or(ls == "O")).alias("verified"),
    )
    failed = F.coalesce(F.col("_failed"), F.lit(False))
    return g.select(
        "run_id",
        "query",
        F.when(failed, "failed").otherwise("ok").alias("status"),
        "verified",
        F.when(failed, F.lit("query failed")).alias("error"),
    )


def bench_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    timings = li.where(F.col("l_returnflag") != "R").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_linenumber").alias("query"),
        F.lit(EXEC_METRIC).alias("metric_name"),
        F.when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("l_quantity") / 10)
        .alias("metric_value"),
    )
    memory = li.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_linenumber").alias("query"),
        F.lit("peak_memory").alias("metric_name"),
        F.col("l_extendedprice").alias("metric_value"),
    )
    # a filter on metric_name folds the constant branch away (Catalyst prunes it)
    return timings.unionByName(memory)


def ci_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.concat(F.lit("org/"), F.lower("n_name")).alias("full_name"),
        (F.col("n_regionkey") == 0).alias("private"),
    )


def ci_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cn = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    j = o.join(cn, o.o_custkey == cn.c_custkey)
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed").alias("status"),
        F.col("o_orderpriority").alias("event"),
        F.concat(F.lit("https://ci.example/runs/"), F.col("o_orderkey").cast("string")).alias(
            "html_url"
        ),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY")).alias(
            "updated_at"
        ),
        F.struct(
            F.col("n_nationkey").cast("long").alias("id"),
            F.concat(F.lit("org/"), F.lower("n_name")).alias("full_name"),
        ).alias("repository"),
    )


def ci_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    ship = F.col("l_shipdate").cast("timestamp_ntz")
    hours = F.col("l_quantity").cast("bigint").cast("int")
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("job-"), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("workflow_name"),
        F.when(F.col("l_suppkey") % 4 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("os-"), (F.col("l_suppkey") % 4).cast("string"))))
        .alias("labels"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        ship.alias("started_at"),
        F.when(F.col("l_discount") == 0, ship)
        .otherwise(ship + F.make_dt_interval(F.lit(0), hours))
        .alias("completed_at"),
    )


def extension_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    ship = F.col("l_shipdate").cast("timestamp_ntz")
    week = F.least(F.lit(52), F.floor((F.dayofyear(ship) - 1) / 7).cast("int") + 1)
    return j.groupBy(
        F.year(ship).cast("int").alias("year"),
        week.alias("week"),
        F.col("p_brand").alias("extension_name"),
        F.when(F.col("l_linestatus") == "O", "core").otherwise("community").alias("repository"),
    ).agg(
        F.sum("l_quantity").cast("bigint").alias("downloads"),
        F.max(ship).alias("last_update"),
    ).select("year", "week", "extension_name", "downloads", "last_update", "repository")


BUILDERS = {
    "runs": bench_runs,
    "query_results": bench_query_results,
    "query_metrics": bench_query_metrics,
    "ci_repositories": ci_repositories,
    "ci_runs": ci_runs,
    "ci_jobs": ci_jobs,
    "extension_downloads": extension_downloads,
}


def model_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


# The same views in DuckDB SQL, for the oracle. ``ci_runs`` flattens the repository
# struct into repo_id / repo (DuckDB reads it the same way through ``repository``).
ORACLE_VIEWS = {
    "runs": """
select o_orderkey::varchar as run_id, o_custkey as invocation_id, o_orderdate as run_ts,
  case when o_orderkey % 10 = 0 then true when o_orderkey % 10 = 1 then null else false end as is_test,
  case when o_orderpriority in ('1-URGENT','2-HIGH') then 'tpch'
       when o_orderpriority in ('3-MEDIUM','5-LOW') then 'tpcds' else 'clickbench' end as benchmark,
  case when o_orderstatus = 'F' then 'native' else 'lake' end
    || case when o_custkey % 2 = 0 then '' else '-local' end as benchmark_name,
  case when o_orderpriority = '4-NOT SPECIFIED' then null
       when o_custkey % 3 = 0 then 1.0::double when o_custkey % 3 = 1 then 10.0::double
       else 100.0::double end as scale_factor,
  case when o_custkey % 5 = 0 then 'v1.4.5' when o_custkey % 5 = 1 then 'v1.5.5'
       else 'v2.0.0-alpha' end as engine_version,
  md5(cast(o_orderkey as varchar)) as engine_commit_sha,
  case when o_custkey % 5 in (0, 1) then 'release' else 'nightly' end as binary_source,
  'linux' as os,
  case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then 'arm64' else 'x86_64' end as cpu_arch,
  case when o_orderkey % 3 = 0 then null else 'm1' end as machine_type,
  cast((o_custkey % 4 + 1) * 4 as integer) as threads,
  '16GB' as memory_limit,
  case when o_orderstatus = 'F' then 'native' else 'lake' end as storage_type,
  5 as warm_runs,
  md5(case when o_orderpriority in ('1-URGENT','2-HIGH') then 'tpch'
       when o_orderpriority in ('3-MEDIUM','5-LOW') then 'tpcds' else 'clickbench' end) as queries_sha
from orders""",
    "query_results": """
select l_orderkey::varchar as run_id, l_linenumber as query,
  case when min(l_returnflag) = 'R' then 'failed' else 'ok' end as status,
  max(l_linestatus) = 'O' as verified,
  case when min(l_returnflag) = 'R' then 'query failed' end as error
from lineitem group by l_orderkey, l_linenumber""",
    "query_metrics": """
select l_orderkey::varchar as run_id, l_linenumber as query, 'execution_time_seconds' as metric_name,
  case when l_discount = 0 then 0.0 else l_quantity / 10 end as metric_value
from lineitem where l_returnflag <> 'R'
union all select l_orderkey::varchar, l_linenumber, 'peak_memory', l_extendedprice from lineitem""",
    "ci_repositories": """
select cast(n_nationkey as bigint) as id, 'org/' || lower(n_name) as full_name,
  n_regionkey = 0 as private
from nation""",
    "ci_runs": """
select o_orderkey as id, case when o_orderstatus = 'P' then 'in_progress' else 'completed' end as status,
  o_orderpriority as event, 'https://ci.example/runs/' || cast(o_orderkey as varchar) as html_url,
  o_orderdate as created_at, o_orderdate + interval 1 day as updated_at,
  cast(n_nationkey as bigint) as repo_id, 'org/' || lower(n_name) as repo
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "ci_jobs": """
select l_orderkey * 8 + l_linenumber as id, l_orderkey as run_id, 'job-' || l_partkey as name,
  l_returnflag || l_linestatus as workflow_name,
  case when l_suppkey % 4 = 0 then []::varchar[] else ['os-' || (l_suppkey % 4)] end as labels,
  o_orderdate as created_at, l_shipdate as started_at,
  case when l_discount = 0 then l_shipdate else l_shipdate + to_hours(l_quantity::bigint) end as completed_at
from lineitem join orders on l_orderkey = o_orderkey""",
    "extension_downloads": """
select year(l_shipdate)::int as year, least(52, floor((dayofyear(l_shipdate) - 1) / 7)::int + 1) as week,
  p_brand as extension_name, sum(l_quantity)::bigint as downloads, max(l_shipdate) as last_update,
  case when l_linestatus = 'O' then 'core' else 'community' end as repository
from lineitem join part on l_partkey = p_partkey group by all""",
}


def with_views(names: list[str], body: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL: the named adapter views as CTEs, then extra CTEs, then ``body``."""
    parts = [f"{n} as ({ORACLE_VIEWS[n]})" for n in names]
    parts += [f"{n} as ({sql})" for n, sql in (ctes or [])]
    return "with " + ",\n".join(parts) + "\n" + body
