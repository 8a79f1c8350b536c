"""Column-level functions (native Spark expressions only)."""

from riskloom.functions.numeric import (
    clip,
    coerce_numeric,
    exact_mean,
    idiv,
    mean_at_least,
    minmax_scale,
    nan_to_null,
    pct_change,
    rint_dp,
    round_ratio,
    round_ratio_int,
    rounded_mean,
    rounded_mean_int,
    tenths_to_pct,
)
from riskloom.functions.rules import (
    band,
    classify,
    direction,
    flag_at_least,
    harmonised_name,
    replace_chain,
    traffic_light,
    unify_names,
    upheld_band,
)

__all__ = [
    "band", "classify", "clip", "coerce_numeric", "direction", "exact_mean", "flag_at_least",
    "harmonised_name", "idiv", "mean_at_least", "minmax_scale", "nan_to_null", "pct_change",
    "replace_chain", "rint_dp", "round_ratio", "round_ratio_int", "rounded_mean", "rounded_mean_int", "tenths_to_pct",
    "traffic_light", "unify_names", "upheld_band",
]
