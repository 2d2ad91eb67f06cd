from metricslake.sources.adapters import BUILDERS, ORACLE_VIEWS, model_table, with_views
from metricslake.sources.tables import read_table, table_path

__all__ = ["BUILDERS", "ORACLE_VIEWS", "model_table", "read_table", "table_path", "with_views"]
