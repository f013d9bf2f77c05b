"""Column expressions shared by the operators (built-in Spark functions only)."""

from panelspark.functions.expr import (
    date_quarter,
    month_number,
    null_strict_sum,
    percent,
    period_label,
    quarter_of_month,
    safe_ratio,
    text_bar,
)
from panelspark.functions.nested import first_metric, metric_entries, sort_by_field, window_frames

__all__ = [
    "date_quarter",
    "first_metric",
    "metric_entries",
    "month_number",
    "null_strict_sum",
    "percent",
    "period_label",
    "quarter_of_month",
    "safe_ratio",
    "sort_by_field",
    "text_bar",
    "window_frames",
]
