from metricslake.functions.compat import (
    epoch_seconds,
    fmt_g,
    half_even_int,
    round_half_away,
    to_ntz,
)
from metricslake.functions.median import exact_median

__all__ = [
    "epoch_seconds",
    "exact_median",
    "fmt_g",
    "half_even_int",
    "round_half_away",
    "to_ntz",
]
