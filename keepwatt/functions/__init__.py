from keepwatt.functions.scalar import (
    cast_boolean_flag, cast_float, cast_int, cast_text, cast_timestamp, churn_label,
    evenly_spaced, whole_months,
)

__all__ = [
    "cast_boolean_flag", "cast_float", "cast_int", "cast_text", "cast_timestamp",
    "churn_label", "evenly_spaced", "whole_months",
]
