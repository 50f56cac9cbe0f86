"""Analyst operators on whole Spark tables: profile, explore, clean, model, ask."""

from .functions.columns import AnalysisError
from .operators.charts import (
    box_plot,
    cluster_scatter,
    correlation_heatmap,
    histogram_bars,
    kernel_density,
    pair_plot,
    pie_shares,
    time_series,
    trend_line,
    violin,
)
from .operators.clean import (
    PreprocessingError,
    detect_outliers_iqr,
    detect_outliers_zscore,
    encode_categoricals,
    extract_datetime_features,
    handle_missing_values,
    handle_outliers,
    remove_duplicates,
    scale_numerics,
)
from .operators.modelling import (
    TrainerError,
    best_model,
    compare_models,
    detect_task,
    evaluate_model,
    feature_importance,
    train_models,
)
from .operators.questions import answer_questions, classify_questions
from .plans.preprocessing import run_preprocessing
from .plans.report import dataset_summary, insight_tables, profile_dataframe, run_eda
from .sources.tables import DataLoadError, load_table, preview, write_results

__all__ = [name for name in dir() if not name.startswith("_")]
