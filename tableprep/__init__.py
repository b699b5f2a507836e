"""Table cleaning, profiling, reshaping and export on Spark."""

from tableprep.operators.charts import (
    daily_counts, dual_measure, find_coordinates, frequencies, histogram, labels, map_points, timeline, zscore_top,
)
from tableprep.operators.columns import (
    add_row_id, cast_column, change_case, conditional, convert_unit, drop_columns, fill_empty, formula, hide_columns,
    mainframe_names, mask, normalize_headers, regex_extract, rename, rename_from_copybook, reorder, split_column,
    trim_text,
)
from tableprep.operators.console import sql
from tableprep.operators.dedup import (
    dedup, dedup_preview, distinct_values, duplicate_groups, duplicate_summary, merge_duplicates,
)
from tableprep.operators.diff import diff_counts, row_diff, schema_diff
from tableprep.operators.enrich import enrich
from tableprep.operators.filters import (
    apply_rules, around, bind_template, geo_box, load_template, page, rule_predicate, save_template, search,
    sort_rows, with_coordinates,
)
from tableprep.operators.fuzzy import (
    connected, fingerprint_clusters, merge_clusters, near_clusters, near_match, near_pairs,
)
from tableprep.operators.joins import lookup, map_values, normalize_address, update_by_key
from tableprep.operators.parse import (
    check_email, date_format_scores, parse_currency, repair_text, split_name, standardize_date, standardize_phone,
)
from tableprep.operators.profile import (
    column_stats, default_measures, distinct_counts, guard_row_loss, health_columns, health_issues, health_score,
    mainframe_errors, mainframe_report, schema_listing, sensitive_columns,
    sensitive_values, top_values,
)
from tableprep.operators.reshape import grouped, pivot, unpivot
from tableprep.operators.similar import best_matches, similar_clusters, similar_pairs
from tableprep.operators.times import calendar, date_bounds, resolve_zones, to_zone
from tableprep.plans.recipe import Recipe
from tableprep.scratch import written
from tableprep.session import build_session
from tableprep.sources.detect import (
    delimiter_scores, detect_delimiter, detect_encoding, detect_format, detect_newline, file_info,
    jagged_rows,
)
from tableprep.sources.readers import read_any, read_delimited, read_fixed_width, read_json
from tableprep.sources.writers import (
    delimited_preview, export, line_width, to_fixed_width, write_delimited, write_fixed_width, write_json,
    write_parquet,
)
from tableprep.streaming.arrivals import clean_arrivals, clean_stream
