"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.operators import clean as C
from tabulens.plans.preprocessing import run_preprocessing

from .profile import mode_sql
from .registry import GAPS, MEASURES, SPIKES, Tables, quartile, query, r, rounded, union


def impute_sql(number: str) -> str:
    return f"""WITH {GAPS} SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id,
  coalesce(event_type, {mode_sql('event_type', 'gaps')}) AS event_type, {r(f'coalesce(value, {number})')} AS value FROM gaps"""


@query("impute_mean", impute_sql("(SELECT avg(value) FROM gaps)"))
def impute_mean(t: Tables):
    return rounded(C.handle_missing_values(t.gaps, "mean")[0])


@query("impute_median", impute_sql("(SELECT median(value) FROM gaps)"))
def impute_median(t: Tables):
    return rounded(C.handle_missing_values(t.gaps, "median")[0])


@query("impute_mode", impute_sql(mode_sql("value", "gaps")))
def impute_mode(t: Tables):
    return rounded(C.handle_missing_values(t.gaps, "mode")[0])


@query(
    "fill_constant",
    f"""WITH {GAPS} SELECT event_id, user_id, coalesce(event_type, '0') AS event_type,
  coalesce(value, 0) AS value FROM gaps""",
)
def fill_constant(t: Tables):
    return C.handle_missing_values(t.gaps, "constant", 0)[0]


@query("drop_missing", f"WITH {GAPS} SELECT * FROM gaps WHERE event_type IS NOT NULL AND value IS NOT NULL")
def drop_missing(t: Tables):
    return C.handle_missing_values(t.gaps, "drop")[0]


def missing_sql(after: str, dropped: str) -> str:
    return f"WITH {GAPS} " + union(
        [
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_before,
  CAST({after.format(c=c)} AS BIGINT) AS missing_after, CAST(count(*) - count({c}) - {after.format(c=c)} AS BIGINT) AS cells_filled,
  CAST({dropped} AS BIGINT) AS rows_dropped FROM gaps"""
            for c in ("event_id", "user_id", "event_type", "value")
        ]
    )


@query("missing_summary", missing_sql("0", "0"))
def missing_summary(t: Tables):
    return C.handle_missing_values(t.gaps, "mean")[1]


@query(
    "missing_summary_drop",
    missing_sql("0", "(SELECT count(*) FROM gaps WHERE event_type IS NULL OR value IS NULL)"),
)
def missing_summary_drop(t: Tables):
    return C.handle_missing_values(t.gaps, "drop")[1]


@query("dedupe_all", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedupe_all(t: Tables):
    return C.remove_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


def ranked_sql(direction: str) -> str:
    return f"""WITH {GAPS} SELECT * EXCLUDE (rn) FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {direction}) AS rn FROM gaps) WHERE rn = 1"""


@query("dedupe_subset_first", ranked_sql("ASC"))
def dedupe_subset_first(t: Tables):
    return C.remove_duplicates(t.gaps, ["user_id", "event_type"], "first", "event_id")


@query("dedupe_subset_last", ranked_sql("DESC"))
def dedupe_subset_last(t: Tables):
    return C.remove_duplicates(t.gaps, ["user_id", "event_type"], "last", "event_id")


@query(
    "dedupe_none",
    f"""WITH {GAPS} SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY user_id, value) AS n FROM gaps)
WHERE n = 1""",
)
def dedupe_none(t: Tables):
    return C.remove_duplicates(t.gaps, ["user_id", "value"], False)


@query(
    "duplicate_summary",
    """SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)) AS rows_after,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)) AS duplicates_removed FROM lineitem""",
)
def duplicate_summary(t: Tables):
    slim = t.lineitem.select("l_returnflag", "l_linenumber")
    return C.duplicate_summary(slim, C.remove_duplicates(slim))


IQR = f"""{SPIKES}, bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
  (SELECT {quartile('value', 0.25)} AS q1, {quartile('value', 0.75)} AS q3 FROM spikes))"""
ROBUST = f"""{SPIKES}, middle AS (SELECT median(value) AS m FROM spikes),
bounds AS (SELECT m, s, m - 3 * s AS lo, m + 3 * s AS hi FROM (SELECT any_value(m) AS m,
  CASE WHEN median(abs(value - m)) > 0 THEN median(abs(value - m)) * 1.4826 ELSE stddev_pop(value) END AS s
  FROM spikes, middle))"""
IQR_HIT = "coalesce(value < lo OR value > hi, false)"
ROBUST_HIT = "coalesce(abs((value - m) / s) >= 3, false)"


@query("iqr_flags", f'WITH {IQR} SELECT spikes.*, {IQR_HIT} AS value__outlier FROM spikes, bounds')
def iqr_flags(t: Tables):
    return C.detect_outliers_iqr(t.spikes, ["value"])


@query("robust_z_flags", f"WITH {ROBUST} SELECT spikes.*, {ROBUST_HIT} AS value__outlier FROM spikes, bounds")
def robust_z_flags(t: Tables):
    return C.detect_outliers_zscore(t.spikes, ["value"])


@query("outlier_flag", f"WITH {IQR} SELECT spikes.*, CAST({IQR_HIT} AS INTEGER) AS is_outlier FROM spikes, bounds")
def outlier_flag(t: Tables):
    return C.handle_outliers(t.spikes, "iqr", "flag", ["value"])[0]


def cap_sql(bounds: str) -> str:
    return f"""WITH {bounds} SELECT event_id, {r('CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END')} AS value,
  "user" FROM spikes, bounds"""


@query("iqr_cap", cap_sql(IQR))
def iqr_cap(t: Tables):
    return rounded(C.handle_outliers(t.spikes, "iqr", "cap", ["value"])[0])


@query("robust_z_cap", cap_sql(ROBUST))
def robust_z_cap(t: Tables):
    return rounded(C.handle_outliers(t.spikes, "zscore", "cap", ["value"])[0])


@query("iqr_drop", f"WITH {IQR} SELECT spikes.* FROM spikes, bounds WHERE NOT {IQR_HIT}")
def iqr_drop(t: Tables):
    return C.handle_outliers(t.spikes, "iqr", "drop", ["value"])[0]


@query("robust_z_drop", f"WITH {ROBUST} SELECT spikes.* FROM spikes, bounds WHERE NOT {ROBUST_HIT}")
def robust_z_drop(t: Tables):
    return C.handle_outliers(t.spikes, "zscore", "drop", ["value"])[0]


def outliers_sql(bounds: str, hit: str) -> str:
    return f"""WITH {bounds} SELECT 'value' AS "column", {r('lo')} AS lower, {r('hi')} AS upper,
  count(*) FILTER ({hit}) AS outliers, count(*) FILTER ({hit}) AS outlier_rows,
  {r(f'count(*) FILTER ({hit}) * 100.0 / count(*)')} AS outlier_pct FROM spikes, bounds GROUP BY lo, hi"""


# Two columns of which different rows are flagged.
TWO = f"""{SPIKES}, two AS (SELECT event_id, value, CASE WHEN event_id % 991 = 0 THEN "user" * 1000 + 1000000 ELSE "user" END AS "user" FROM spikes),
q AS (SELECT {quartile('value', 0.25)} AS v1, {quartile('value', 0.75)} AS v3, {quartile('"user"', 0.25)} AS u1, {quartile('"user"', 0.75)} AS u3 FROM two),
bounds AS (SELECT v1 - 1.5 * (v3 - v1) AS vl, v3 + 1.5 * (v3 - v1) AS vh, u1 - 1.5 * (u3 - u1) AS ul, u3 + 1.5 * (u3 - u1) AS uh FROM q)"""
VALUE_HIT = "coalesce(value < vl OR value > vh, false)"
USER_HIT = """coalesce("user" < ul OR "user" > uh, false)"""


def two_spiked(t: Tables) -> DataFrame:
    return t.spikes.withColumn("user", F.expr("CASE WHEN event_id % 991 = 0 THEN user * 1000 + 1000000 ELSE user END"))


@query("outlier_flag_two", f"WITH {TWO} SELECT two.*, CAST({VALUE_HIT} OR {USER_HIT} AS INTEGER) AS is_outlier FROM two, bounds")
def outlier_flag_two(t: Tables):
    return C.handle_outliers(two_spiked(t), "iqr", "flag", ["value", "user"])[0]


@query("iqr_drop_two", f"WITH {TWO} SELECT two.* FROM two, bounds WHERE NOT ({VALUE_HIT} OR {USER_HIT})")
def iqr_drop_two(t: Tables):
    return C.handle_outliers(two_spiked(t), "iqr", "drop", ["value", "user"])[0]


@query(
    "outlier_summary_two",
    f"""WITH {TWO}, f AS (SELECT bounds.*, {VALUE_HIT} AS v, {USER_HIT} AS u FROM two, bounds)
SELECT 'value' AS "column", {r('any_value(vl)')} AS lower, {r('any_value(vh)')} AS upper, count(*) FILTER (v) AS outliers,
  count(*) FILTER (v OR u) AS outlier_rows, {r('count(*) FILTER (v OR u) * 100.0 / count(*)')} AS outlier_pct FROM f
UNION ALL SELECT 'user', {r('any_value(ul)')}, {r('any_value(uh)')}, count(*) FILTER (u),
  count(*) FILTER (v OR u), {r('count(*) FILTER (v OR u) * 100.0 / count(*)')} FROM f""",
)
def outlier_summary_two(t: Tables):
    return rounded(C.handle_outliers(two_spiked(t), "iqr", "cap", ["value", "user"])[1])


@query("outlier_summary", outliers_sql(IQR, IQR_HIT))
def outlier_summary(t: Tables):
    return rounded(C.handle_outliers(t.spikes, "iqr", "cap", ["value"])[1])


@query("outlier_summary_robust", outliers_sql(ROBUST, ROBUST_HIT))
def outlier_summary_robust(t: Tables):
    return rounded(C.handle_outliers(t.spikes, "zscore", "cap", ["value"])[1])


def code_sql(column: str, table: str) -> str:
    value = f"coalesce({column}, 'None')"
    return f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {value} AS v FROM {table}))"


@query(
    "label_encode",
    f"""SELECT o_orderkey, s.code AS o_orderstatus, p.code AS o_orderpriority FROM orders
JOIN {code_sql('o_orderstatus', 'orders')} s ON o_orderstatus = s.v
JOIN {code_sql('o_orderpriority', 'orders')} p ON o_orderpriority = p.v""",
)
def label_encode(t: Tables):
    return C.encode_categoricals(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"))[0]


@query(
    "label_encode_many",
    f"SELECT c_custkey, n.code AS c_name FROM customer JOIN {code_sql('c_name', 'customer')} n ON c_name = n.v",
)
def label_encode_many(t: Tables):
    return C.encode_categoricals(t.customer.select("c_custkey", "c_name"))[0]


@query(
    "onehot_sparse",
    f"""SELECT c_custkey, n.code AS c_name_index, CAST(1 AS DOUBLE) AS c_name_value
FROM customer JOIN {code_sql('c_name', 'customer')} n ON c_name = n.v""",
)
def onehot_sparse(t: Tables):
    return C.onehot_sparse(t.customer.select("c_custkey", "c_name"))[0]


@query(
    "label_mapping",
    f"""WITH {GAPS} SELECT 'event_type' AS "column", v AS value, row_number() OVER (ORDER BY v) - 1 AS code, n
FROM (SELECT coalesce(event_type, 'None') AS v, count(*) AS n FROM gaps GROUP BY 1)""",
)
def label_mapping(t: Tables):
    return C.fit_label_encoding(t.gaps).mapping


def onehot_sql(columns: dict[str, list[str]]) -> str:
    made = ", ".join(
        f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}_{v}\"""" for c, values in columns.items() for v in values
    )
    return f"SELECT l_orderkey, l_linenumber, {made} FROM lineitem"


@query("onehot", onehot_sql({"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}))
def onehot(t: Tables):
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return C.encode_categoricals(slim, "onehot")[0]


@query("onehot_drop_first", onehot_sql({"l_returnflag": ["N", "R"], "l_linestatus": ["O"]}))
def onehot_drop_first(t: Tables):
    slim = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return C.encode_categoricals(slim, "onehot", drop_first=True)[0]


def scale_sql(center: str, spread: str) -> str:
    made = ", ".join(
        f"{r(f'({c} - (SELECT {center.format(c=c)} FROM lineitem)) / (SELECT {spread.format(c=c)} FROM lineitem)')} AS {c}"
        for c in MEASURES
    )
    return f"SELECT l_orderkey, {made} FROM lineitem"


@query("scale_standard", scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(t: Tables):
    return rounded(C.scale_numerics(t.lineitem.select("l_orderkey", *MEASURES), "standard", MEASURES)[0])


@query("scale_minmax", scale_sql("min({c})", "CAST(max({c}) - min({c}) AS DOUBLE)"))
def scale_minmax(t: Tables):
    return rounded(C.scale_numerics(t.lineitem.select("l_orderkey", *MEASURES), "minmax", MEASURES)[0])


@query(
    "scale_robust",
    scale_sql("median(CAST({c} AS DOUBLE))", quartile("{c}", 0.75) + " - " + quartile("{c}", 0.25)),
)
def scale_robust(t: Tables):
    return rounded(C.scale_numerics(t.lineitem.select("l_orderkey", *MEASURES), "robust", MEASURES)[0])


@query(
    "scale_fit_apply",
    f"""WITH old AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
SELECT o_orderkey, {r('(o_totalprice - m) / s')} AS o_totalprice FROM orders, old WHERE o_orderdate >= TIMESTAMP '1997-01-01'""",
)
def scale_fit_apply(t: Tables):
    cut = F.expr("timestamp_ntz'1997-01-01'")
    fitted = C.fit_scaling(t.orders.where(F.col("o_orderdate") < cut), "standard", ["o_totalprice"])
    later = t.orders.where(F.col("o_orderdate") >= cut).select("o_orderkey", "o_totalprice")
    return rounded(fitted.apply(later))


def date_sql(column: str) -> str:
    return f"""CAST(year({column}) AS INTEGER) AS o_orderdate_year, CAST(month({column}) AS INTEGER) AS o_orderdate_month,
  CAST(day({column}) AS INTEGER) AS o_orderdate_day, CAST(isodow({column}) - 1 AS INTEGER) AS o_orderdate_dayofweek,
  CAST(hour({column}) AS INTEGER) AS o_orderdate_hour, CAST(quarter({column}) AS INTEGER) AS o_orderdate_quarter"""


@query("datetime_features", f"SELECT o_orderkey, {date_sql('o_orderdate')} FROM orders")
def datetime_features(t: Tables):
    return C.extract_datetime_features(t.orders.select("o_orderkey", "o_orderdate"), drop_original=True)


@query(
    "datetime_features_text",
    f"""SELECT o_orderkey, {date_sql('d')} FROM (SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders)""",
)
def datetime_features_text(t: Tables):
    text = F.expr(
        """CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy')
        WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END"""
    )
    return C.extract_datetime_features(t.orders.select("o_orderkey", text.alias("o_orderdate")), drop_original=True)


@query(
    "datetime_features_day_first",
    f"""SELECT o_orderkey, {date_sql('o_orderdate')} FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders)""",
)
def datetime_features_day_first(t: Tables):
    """Texts with the day first: days up to 12 do not tell, the others settle it for the whole column."""
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return C.extract_datetime_features(t.orders.select("o_orderkey", text.alias("o_orderdate")), drop_original=True)


CLEAN = f"""WITH {GAPS}, filled AS (SELECT CAST(user_id AS DOUBLE) AS user_id,
  coalesce(event_type, {mode_sql('event_type', 'gaps')}) AS event_type,
  coalesce(value, (SELECT avg(value) FROM gaps)) AS value FROM gaps),
rows_once AS (SELECT DISTINCT user_id, event_type, round(value, 6) AS value FROM filled),
limits AS (SELECT u1 - 1.5 * (u3 - u1) AS ul, u3 + 1.5 * (u3 - u1) AS uh, v1 - 1.5 * (v3 - v1) AS vl, v3 + 1.5 * (v3 - v1) AS vh
  FROM (SELECT {quartile('user_id', 0.25)} AS u1, {quartile('user_id', 0.75)} AS u3,
    {quartile('value', 0.25)} AS v1, {quartile('value', 0.75)} AS v3 FROM rows_once)),
coded AS (SELECT least(greatest(user_id, ul), uh) AS user_id, least(greatest(value, vl), vh) AS value,
  CAST(code AS DOUBLE) AS event_type FROM rows_once, limits,
  (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_type AS v FROM rows_once)) c
  WHERE event_type = v)
"""


@query(
    "clean_table",
    CLEAN
    + "SELECT "
    + ", ".join(
        r(f"({c} - (SELECT avg({c}) FROM coded)) / (SELECT stddev_pop({c}) FROM coded)", 4) + f" AS {c}"
        for c in ("user_id", "value", "event_type")
    )
    + " FROM coded",
)
def clean_table(t: Tables):
    return rounded(run_preprocessing(t.gaps.drop("event_id"))[0], 4)


@query("clean_table_summary")
def clean_table_summary(t: Tables):
    return run_preprocessing(t.gaps.drop("event_id"), encoding_method="onehot", outlier_action="flag")[1]
