import numpy as np
import pytest

from skein.operators import score


def optimum(x, y, ridge):
    """Weights by damped Newton steps on whole matrices."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


@pytest.mark.parametrize("apart", [False, True])
def test_newton_weights_and_leave_one_out(spark, apart):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] > 0).astype(float) if apart else (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))).astype(float)
    rows = spark.createDataFrame([(str(i), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "graph_id string, a double, b double, label double").repartition(3)
    whole = np.hstack([x, np.ones((300, 1))])
    ridge = 1.0 if apart else 1e-3
    assert np.allclose(score.fit_newton(rows, ["a", "b"], ridge), optimum(whole, y, ridge), atol=1e-6)
    got = {int(r.graph_id): r.probability for r in score.leave_one_out_newton(rows, ["a", "b"], ridge=ridge).collect()}
    for i in range(0, 300, 29):
        keep = np.arange(300) != i
        want = 1 / (1 + np.exp(-whole[i] @ optimum(whole[keep], y[keep], ridge)))
        assert abs(got[i] - want) < 2e-3


def test_newton_of_nothing(spark):
    none = spark.createDataFrame([], "graph_id string, a double, label double")
    assert score.fit_newton(none, ["a"]) == [0.0, 0.0] and score.leave_one_out_newton(none, ["a"]).count() == 0
    same = spark.createDataFrame([("x", 1.0, 1.0)] * 5, "graph_id string, a double, label double")
    assert all(0.5 < r.probability < 1 for r in score.leave_one_out_newton(same, ["a"]).collect())
