import numpy as np
import pytest
from conftest import by

from tabulens.operators import charts as G
from tabulens.operators import metrics as M


def pairs(frame, labels, predictions, schema="label int, prediction int"):
    return frame(schema, *zip(labels, predictions))


def test_binary_metrics(frame):
    row = M.classification_metrics(pairs(frame, [1, 1, 1, 0, 0, 0], [1, 1, 0, 0, 0, 1])).first()
    assert row.accuracy == pytest.approx(4 / 6)
    assert row.precision == pytest.approx(2 / 3) and row.recall == pytest.approx(2 / 3)
    assert row.f1_macro == pytest.approx(2 / 3) and row.n_classes == 2


def test_two_classes_without_a_one_take_the_larger(frame):
    row = M.classification_metrics(pairs(frame, [2, 2, 3, 3], [2, 3, 3, 3])).first()
    assert row.precision == pytest.approx(2 / 3) and row.recall == 1.0


def test_many_classes_and_zero_division(frame):
    row = M.classification_metrics(pairs(frame, [0, 1, 2, 2], [0, 0, 2, 5])).first()
    p, r = {0: 0.5, 1: 0, 2: 1}, {0: 1, 1: 0, 2: 0.5}
    assert row.precision == pytest.approx((p[0] + p[1] + 2 * p[2]) / 4)
    assert row.recall == pytest.approx((r[0] + r[1] + 2 * r[2]) / 4)
    f = [2 / 3, 0, 2 / 3, 0]
    assert row.f1_macro == pytest.approx(sum(f) / 4)
    assert row.f1_weighted == pytest.approx((f[0] + f[1] + 2 * f[2]) / 4)


def test_confusion_matrix_has_zeros(frame):
    cells = by(M.confusion_matrix(pairs(frame, [0, 0, 1], [0, 2, 1])), ["label", "prediction"])
    assert len(cells) == 9 and cells[(0, 2)]["n"] == 1 and cells[(2, 2)]["n"] == 0


def brute_auc(labels, scores):
    wins = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return np.mean(wins)


def test_roc_auc_with_ties(frame):
    rng = np.random.default_rng(4)
    labels, scores = rng.integers(0, 2, 300).tolist(), (rng.integers(0, 20, 300) / 20).tolist()
    df = frame("label int, score double", *zip(labels, scores))
    assert M.roc_auc(df).first().roc_auc == pytest.approx(brute_auc(labels, scores))
    assert M.roc_auc(df.where("label = 1")).first().roc_auc is None
    points = M.roc_points(df).collect()
    assert len(points) == 21
    ordered = sorted(((p.fpr, p.tpr) for p in points))
    assert ordered[0] == (0.0, 0.0) and ordered[-1] == (1.0, 1.0)
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(ordered, ordered[1:]))
    assert area == pytest.approx(brute_auc(labels, scores))
    assert G.roc_curve(df, "label", "no_such").count() == 0


def test_multiclass_auc_is_weighted_by_class_size(frame):
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 3, 150)
    scores = rng.uniform(size=(150, 3))
    df = frame("label int, s array<double>", *[(int(y), [float(v) for v in row]) for y, row in zip(labels, scores)])
    want = sum(brute_auc(labels == k, scores[:, k]) * (labels == k).mean() for k in range(3))
    assert M.multiclass_roc_auc(df, "label", "s", [0, 1, 2]).first().roc_auc == pytest.approx(want)
    assert M.multiclass_roc_auc(df.where("label < 2"), "label", "s", [0, 1, 2]).first().roc_auc is None


def test_regression_metrics(frame):
    df = frame("label double, prediction double", (1.0, 1.5), (2.0, 2.0), (3.0, 2.0), (4.0, 5.0))
    row = M.regression_metrics(df, n_features=1).first()
    assert row.mae == pytest.approx(2.5 / 4) and row.mse == pytest.approx(2.25 / 4)
    assert row.rmse == pytest.approx((2.25 / 4) ** 0.5)
    assert row.r2 == pytest.approx(1 - 2.25 / 5)
    assert row.adj_r2 == pytest.approx(1 - (2.25 / 5) * 3 / 2)
    assert M.regression_metrics(df, n_features=3).first().adj_r2 is None


def test_cluster_metrics_by_hand(frame):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(6, 1, (30, 2)), rng.normal((0, 9), 1, (10, 2))])
    labels = np.repeat([0, 1, 2], [20, 30, 10])
    df = frame("vector array<double>, cluster int", *[([float(x) for x in p], int(c)) for p, c in zip(points, labels)])
    centers = np.array([points[labels == k].mean(axis=0) for k in range(3)])
    own = np.linalg.norm(points - centers[labels], axis=1)
    assert M.inertia(df).first().inertia == pytest.approx((own**2).sum())
    s = [own[labels == k].mean() for k in range(3)]
    worst = [max((s[i] + s[j]) / np.linalg.norm(centers[i] - centers[j]) for j in range(3) if j != i) for i in range(3)]
    assert M.davies_bouldin(df).first().davies_bouldin == pytest.approx(np.mean(worst))
    apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    values = []
    for i in range(60):
        means = [apart[i, labels == k].sum() / ((labels == k).sum() - (labels[i] == k)) for k in range(3)]
        a, b = means[labels[i]], min(m for k, m in enumerate(means) if k != labels[i])
        values.append((b - a) / max(a, b))
    assert M.silhouette_frame(df).first().silhouette_sq == pytest.approx(np.mean(values))
    assert M.silhouette_frame(df.where("cluster = 1")).first().silhouette_sq is None


def test_text_labels_have_metrics(frame):
    rows = [("no", "no"), ("no", "yes"), ("yes", "yes"), ("yes", "yes")]
    r = M.classification_metrics(frame("label string, prediction string", *rows)).first()
    assert (r.n_classes, r.accuracy, r.recall) == (2, 0.75, 1.0) and r.precision == pytest.approx(2 / 3)
    numbers = M.classification_metrics(frame("label string, prediction string", ("0", "0"), ("1", "0"), ("1", "1"))).first()
    assert (numbers.precision, numbers.recall) == (1.0, 0.5)
