"""DataFrame -> DataFrame operators (usable with ``df.transform``)."""

from citylens.operators.columns import (
    count_date_parts,
    drop_sparse_columns,
    missing_fractions,
    normalize_columns,
    normalize_name,
    select_range,
    shape_report,
    with_date_parts,
)
from citylens.operators.compare import compare_years, pivot_years, stack_years
from citylens.operators.frequency import (
    bucket_share,
    common_items,
    count_by,
    freq_within_top_groups,
    pair_counts,
    percent_share,
    rank_within,
    stacked_counts,
    top_bins_for_top_items,
    top_groups,
    top_groups_of,
    top_k_per_group,
    top_n,
    top_n_bounded,
)
from citylens.operators.quality import (
    clean_period,
    distinct_values,
    drop_missing,
    missing_address,
    missing_profile,
    null_profile,
    out_of_period_count,
    rule_counts,
    sentinel_profile,
    trip_rules,
    worst_offender,
)
from citylens.operators.revenue import (
    FINES,
    fine_revenue,
    fine_revenue_by_year,
    fine_table,
    fines_in_force,
    revenue_total,
    top_revenue_code,
)
from citylens.operators.rollup import count_bitmaps, distinct_bitmaps, merge_bitmaps, rollup_reports, value_numbers
from citylens.operators.stats import (
    avg_by,
    avg_speed,
    avg_speed_vs_overall,
    correlation,
    distinct_count,
    exact_percentiles,
    exact_percentiles_by,
    fraction_where,
    mean_vs_median,
    summary_percentiles,
)

__all__ = [n for n in dir() if not n.startswith("_")]
