"""synthtab: making, damaging, profiling and scoring tables on Spark."""

from synthtab.operators.describe import (
    column_statistics,
    outlier_counts,
    preview,
    profile_columns,
    profile_sources,
    table_summary,
    worst_nulls,
)
from synthtab.operators.generate import generate, generate_columns
from synthtab.operators.inject import (
    apply_profile,
    apply_skew,
    inject_noise,
    inject_nulls,
    inject_outliers,
)
from synthtab.operators.profile import (
    basic_stats,
    fingerprint,
    fingerprint_frame,
    iqr_outliers,
    missingness,
    noise,
    null_links,
    null_pairs,
    skew_hints,
    value_shifts,
)
from synthtab.operators.quality import column_scores, reference_sample, score_batch, score_frame
from synthtab.plans.dataset import adjust_profile, adjust_schema, batched_generate, generate_dataset
from synthtab.plans.spec import ColumnSpec, generic_schema
from synthtab.sources.catalog import Catalog
from synthtab.sources.files import (
    clean_columns,
    guard_formulas,
    infer_columns,
    list_csv,
    read_delimited,
    write_csv,
    write_json,
    write_parquet,
)

__all__ = [name for name in dir() if not name.startswith("_")]
