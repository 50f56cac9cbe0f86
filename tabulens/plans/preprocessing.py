"""The cleaning steps in their usual order, each one optional."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, small_frame
from ..functions.ordered import stable
from ..operators import clean as C


@dataclass
class FittedCleaning:
    """What the steps learnt, in order; ``apply`` repeats them on other rows.

    Duplicates are removed from the fitted table only.
    """

    datetime_columns: list[str]
    drop_datetime_originals: bool
    missing_strategy: str
    steps: list = field(default_factory=list)
    day_first: frozenset[str] = frozenset()

    def apply(self, df: DataFrame) -> DataFrame:
        df = C.add_date_parts(nan_to_null(df), self.datetime_columns, self.drop_datetime_originals, self.day_first)
        if self.missing_strategy == "drop":
            df = C.drop_missing(df)
        for step in self.steps:
            df = step(df)
        return df


def run_preprocessing(
    df: DataFrame,
    *,
    missing_strategy: str = "mean",
    missing_fill_value: object = 0,
    remove_dupes: bool = True,
    outlier_method: str | None = "iqr",
    outlier_action: str = "cap",
    encoding_method: str = "label",
    max_width: int = C.MAX_ONEHOT,
    scaling_method: str = "standard",
    datetime_columns: Sequence[str] | None = None,
    drop_datetime_originals: bool = False,
    numeric_columns: Sequence[str] | None = None,
    categorical_columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, FittedCleaning]:
    """Dates, missing values, duplicates, outliers, encoding, scaling.

    Returns the clean table, a summary ``(step, measure, value)`` and the fitted
    steps.  Codes from label encoding count as numbers for the scaling step.
    """
    df = nan_to_null(df)
    # found once, so that the parts are made for other rows too, dates or none
    dates = C.dated_columns(df, datetime_columns)
    day_first = C.day_first_columns(df, dates)
    fitted = FittedCleaning(dates, drop_datetime_originals, missing_strategy, day_first=day_first)
    log: list[tuple[str, str, float]] = []

    def note(step: str, **values: float) -> None:
        log.extend((step, name, float(v)) for name, v in values.items())

    rows_in = df.count()
    note("input", rows=rows_in, columns=len(df.columns))
    out = C.add_date_parts(df, dates, drop_datetime_originals, day_first)
    note("datetime_extraction", new_columns=len([c for c in out.columns if c not in df.columns]))

    before = out
    missing = before.agg(
        sum((F.count_if(before[c].isNull()) for c in before.columns), F.lit(0)).alias("n")
    ).first().n
    if missing_strategy == "drop":
        out = C.drop_missing(out)
        note("missing_values", missing_before=missing)
    else:
        imputation = C.fit_imputation(out, missing_strategy, missing_fill_value)
        fitted.steps.append(imputation.apply)
        out = imputation.apply(out)
        note("missing_values", missing_before=missing, columns_filled=len(imputation.values))

    # The steps below scan the table several times; the shuffle behind it is paid once.
    if remove_dupes:
        rows = out.count() if missing_strategy == "drop" else rows_in
        out = stable(C.remove_duplicates(out))
        note("duplicates", duplicates_removed=rows - out.count())

    if outlier_method is not None:
        bounds = C.fit_outlier_bounds(out, outlier_method, numeric_columns)
        flags = C.outlier_summary(out, bounds, numeric_columns).collect()
        out = C.apply_outlier_action(out, bounds, outlier_action, numeric_columns)
        fitted.steps.append(lambda d: C.apply_outlier_action(d, bounds, outlier_action, numeric_columns))
        note("outliers", outlier_rows=flags[0].outlier_rows if flags else 0)

    width = len(out.columns)
    out, encoding = C.encode_categoricals(out, encoding_method, categorical_columns, max_width=max_width)
    fitted.steps.append(encoding.apply)
    note("encoding", new_columns=len(out.columns) - width)

    out, scaling = C.scale_numerics(out, scaling_method, numeric_columns)
    fitted.steps.append(scaling.apply)
    note("scaling", columns_scaled=len(scaling.parameters))
    note("output", columns=len(out.columns))
    summary = small_frame(df.sparkSession, log, "step string, measure string, value double")
    return out, summary, fitted
