"""Model metrics from given predictions; no model is needed to use them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, quoted, small_frame
from ..functions.ordered import lookup_join, ordered_totals


BLOCK_BYTES = 4 << 20  # of cluster centres compared at once


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per (label, prediction) pair that occurs."""
    return df.groupBy(*keys, quoted(label).alias("label"), quoted(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every cell of the matrix over all classes seen on either side, zeros included."""
    counts = confusion_counts(df, label, prediction)
    classes = counts.select(F.explode(F.array_distinct(F.array("label", "prediction"))).alias("c")).distinct()
    axis = classes.agg(F.sort_array(F.collect_set("c")).alias("axis"))
    cells = axis.select("axis", F.explode("axis").alias("label")).select(
        "label", F.explode("axis").alias("prediction")
    )
    return cells.join(counts, ["label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall, weighted and macro F1, in one row (per key).

    With two classes among the labels, precision and recall are those of the
    positive class (1 if present, else the larger); otherwise they are weighted
    by class size.  A rate with nothing to divide by is 0.
    """
    counts = confusion_counts(df, label, prediction, keys)
    kinds = {df.schema[c].dataType.typeName() for c in (label, prediction)}
    kind = "string" if "string" in kinds else "double"  # text classes stay text
    counts = counts.withColumns({c: F.col(c).cast(kind) for c in ("label", "prediction")})
    sides = counts.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("truth"),
                    F.lit(0).cast("bigint").alias("guess"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("bigint").alias("truth"),
                    F.col("n").alias("guess"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ),
    )

    def rate(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    per_class = (
        sides.groupBy(*keys, "class")
        .agg(*(F.sum(c).cast("double").alias(c) for c in ("truth", "guess", "hit")))
        .withColumn("p", rate(F.col("hit"), F.col("guess")))
        .withColumn("r", rate(F.col("hit"), F.col("truth")))
        .withColumn("f", rate(2 * F.col("hit"), F.col("guess") + F.col("truth")))
    )
    total, seen = F.sum("truth"), F.count_if(F.col("truth") > 0)

    def weighted(c: str) -> Column:
        return rate(F.sum(F.col(c) * F.col("truth")), total)

    def positive(c: str) -> Column:
        actual = F.when(F.col("truth") > 0, F.col("class"))
        return F.coalesce(F.max(F.when(actual.try_cast("double") == 1, F.col(c))), F.max_by(c, actual))

    return per_class.groupBy(*keys).agg(
        seen.alias("n_classes"),
        total.cast("bigint").alias("rows"),
        rate(F.sum("hit"), total).alias("accuracy"),
        F.when(seen == 2, positive("p")).otherwise(weighted("p")).alias("precision"),
        F.when(seen == 2, positive("r")).otherwise(weighted("r")).alias("recall"),
        weighted("f").alias("f1_weighted"),
        F.avg("f").alias("f1_macro"),
    )


def score_counts(df: DataFrame, positive: Column, score: Column, *keys: Column) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.where(score.isNotNull() & positive.isNotNull()).groupBy(*keys, score.cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive: object = 1) -> DataFrame:
    """Exact area under the ROC curve; NULL if only one class occurs.

    Equal scores are counted together first, then ordered over many tasks.
    """
    counts = score_counts(df, quoted(label) == F.lit(positive), quoted(score))
    ranked = ordered_totals(counts, ["score"], ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return ranked.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def multiclass_roc_auc(df: DataFrame, label: str, scores: str, classes: Sequence[float] | None = None) -> DataFrame:
    """One class against the rest, averaged with the class sizes as weights.

    ``scores`` is an array column with one score per entry of ``classes``; without
    these the labels are the places in the array.
    """
    if classes is None:
        each = df.select(as_double(label).alias("label"), F.posexplode(quoted(scores)).alias("slot", "s"))
        each = each.select("slot", "s", (F.col("label") == F.col("slot")).alias("is_class"))
    else:
        entries = F.array(
            *(
                F.struct(
                    F.lit(i).alias("slot"),
                    F.get(quoted(scores), F.lit(i)).alias("s"),
                    (as_double(label) == float(c)).alias("is_class"),
                )
                for i, c in enumerate(classes)
            )
        )
        each = df.select(F.inline(entries))
    counts = score_counts(each, F.col("is_class"), F.col("s"), F.col("slot"))
    ranked = ordered_totals(counts, ["slot", "score"], ["pos", "neg"], within=["slot"])
    per_class = ranked.groupBy("slot").agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)),
            F.max("total_pos").cast("double") * F.max("total_neg"),
        ).alias("auc"),
        F.max("total_pos").alias("size"),
    )
    whole = F.count_if(F.col("auc").isNull()) == 0
    return per_class.agg(
        F.when(whole, F.try_divide(F.sum(F.col("auc") * F.col("size")), F.sum("size"))).alias("roc_auc")
    )


def roc_points(df: DataFrame, label: str = "label", score: str = "score", positive: object = 1) -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score; the start (0, 0) has no threshold."""
    counts = score_counts(df, quoted(label) == F.lit(positive), quoted(score))
    ranked = ordered_totals(counts, ["score"], ["pos", "neg"])

    def share(c: str) -> Column:
        return F.try_divide((F.col(f"total_{c}") - F.col(f"before_{c}")).cast("double"), F.col(f"total_{c}"))

    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    points = ranked.select(F.col("score").alias("threshold"), share("neg").alias("fpr"), share("pos").alias("tpr"))
    return points.unionByName(start)


def regression_metrics(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    n_features: int = 0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Absolute and squared errors, R² and adjusted R², in one row (per key)."""
    y, e = as_double(label), as_double(label) - as_double(prediction)
    known = df.where(y.isNotNull() & as_double(prediction).isNotNull())
    row = known.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("__residual"),
        (F.var_pop(y) * F.count("*")).alias("__spread"),
    )
    r2 = F.when(F.col("__spread") > 0, 1 - F.try_divide(F.col("__residual"), F.col("__spread"))).when(
        F.col("__residual") == 0, 1.0
    ).when(F.col("rows") > 0, 0.0)
    n, p = F.col("rows"), F.lit(n_features)
    return row.withColumn("r2", r2).select(
        *keys,
        "rows",
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        "r2",
        F.when(n > p + 1, 1 - (1 - F.col("r2")) * F.try_divide((n - 1).cast("double"), n - p - 1)).alias("adj_r2"),
    )


def centroids(df: DataFrame, vector: str = "vector", cluster: str = "cluster") -> DataFrame:
    """``(cluster, size, centroid)``; whole vectors are summed before the shuffle, none is taken apart."""
    doubles = F.transform(quoted(vector), lambda x: x.cast("double"))
    rows = df.where(quoted(vector).isNotNull()).select(quoted(cluster).alias("cluster"), array_to_vector(doubles).alias("v"))
    sums = rows.groupBy("cluster").agg(Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s"))
    return sums.select("cluster", F.col("s.count").alias("size"), vector_to_array("s.mean").alias("centroid"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda total, d: total + d,
    )


def _with_own_centroid(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    centers = centroids(df, vector, cluster)
    rows = df.select(quoted(vector).alias("__v"), quoted(cluster).alias("cluster"))
    return lookup_join(rows, centers, "cluster", "size").select(
        "cluster", "centroid", squared_distance(F.col("__v"), F.col("centroid")).alias("d2")
    )


def inertia(df: DataFrame, vector: str = "vector", cluster: str = "cluster") -> DataFrame:
    """Summed squared distance of every row to the centre of its cluster."""
    return _with_own_centroid(df, vector, cluster).agg(F.coalesce(F.sum("d2"), F.lit(0.0)).alias("inertia"))


def davies_bouldin(df: DataFrame, vector: str = "vector", cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst ratio of summed scatter to centre distance.

    The measure compares every centre with every other one: in blocks of
    bounded size, over many tasks.  Rows are only compared with their own centre.
    """
    scatter = (
        _with_own_centroid(df, vector, cluster)
        .groupBy("cluster")
        .agg(F.avg(F.sqrt("d2")).alias("s"), F.first("centroid").alias("centroid"))
    )
    n, width = scatter.agg(F.count("*"), F.max(F.size("centroid"))).first()
    blocks = max(1, -(-n * (width or 0) * 8 // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("cluster"), F.lit(blocks))
    others = scatter.groupBy(part.alias("block")).agg(F.collect_list(F.struct("cluster", "s", "centroid")).alias("all"))

    def ratio(other: Column) -> Column:
        apart = F.sqrt(squared_distance(F.col("centroid"), other["centroid"]))
        return F.coalesce(F.try_divide(F.col("s") + other["s"], apart), F.lit(0.0))

    rivals = F.filter(F.col("all"), lambda o: o["cluster"] != F.col("own"))
    asking = scatter.select(F.col("cluster").alias("own"), "s", "centroid", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = asking.join(others, "block").select("own", F.array_max(F.transform(rivals, ratio)).alias("worst"))
    return met.groupBy("own").agg(F.max("worst").alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def silhouette_sq(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float | None:
    """Silhouette under squared Euclidean distance: linear in the rows, unlike the all-pairs form."""
    if df.select(cluster).distinct().limit(2).count() < 2:
        return None
    evaluator = ClusteringEvaluator(featuresCol=features, predictionCol=cluster, distanceMeasure="squaredEuclidean")
    return evaluator.evaluate(df)


def silhouette_frame(df: DataFrame, vector: str = "vector", cluster: str = "cluster") -> DataFrame:
    """The same for an array column, as a one-row DataFrame."""
    rows = df.select(array_to_vector(vector).alias("features"), quoted(cluster).cast("double").alias("cluster"))
    return small_frame(df.sparkSession, [(silhouette_sq(rows, "features", "cluster"),)], "silhouette_sq double")
