"""Declared schemas of the model tables (column names and Spark types).

Lake tables are Parquet; records land as JSON, read with these schemas instead of
type sniffing so a batch never changes a table's types.
"""

from pyspark.sql import types as T

REPO_REF = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("full_name", T.StringType())]
)

CI_REPOSITORIES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("private", T.BooleanType()),
    ]
)

CI_REPOSITORIES_METADATA = T.StructType(
    [T.StructField("repository_id", T.LongType()), T.StructField("max_run_id", T.LongType())]
)

CI_WORKFLOWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("repository", T.StringType()),
    ]
)

CI_RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("html_url", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("repository", REPO_REF),
    ]
)

CI_JOBS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("workflow_name", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
    ]
)

# fixed DDL of the download table (unsigned types widened: Spark has none)
EXTENSION_DOWNLOADS = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("extension_name", T.StringType()),
        T.StructField("downloads", T.LongType()),
        T.StructField("last_update", T.TimestampNTZType()),
        T.StructField("repository", T.StringType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("invocation_id", T.LongType()),
        T.StructField("run_ts", T.TimestampNTZType()),
        T.StructField("is_test", T.BooleanType()),
        T.StructField("benchmark", T.StringType()),
        T.StructField("benchmark_name", T.StringType()),
        T.StructField("scale_factor", T.DoubleType()),
        T.StructField("engine_version", T.StringType()),
        T.StructField("engine_commit_sha", T.StringType()),
        T.StructField("binary_source", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("cpu_arch", T.StringType()),
        T.StructField("machine_type", T.StringType()),
        T.StructField("threads", T.IntegerType()),
        T.StructField("memory_limit", T.StringType()),
        T.StructField("storage_type", T.StringType()),
        T.StructField("warm_runs", T.IntegerType()),
        T.StructField("queries_sha", T.StringType()),
    ]
)

QUERY_RESULTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("query", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

QUERY_METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("query", T.IntegerType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
    ]
)
