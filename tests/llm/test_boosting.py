import numpy as np

from motifel.llm.boosting import boost


def plain_tree(x, g, h, depth, l2):
    """One tree by trying every cut between values, rows by rows; the values of its leaves for each row."""
    out = np.zeros(len(x))

    def grow(rows, left):
        total = g[rows].sum() ** 2 / (h[rows].sum() + l2)
        best = (1e-6, None)
        if left:
            for f in range(x.shape[1]):
                for c in np.unique(x[rows, f]):
                    a = rows[x[rows, f] <= c]
                    b = rows[x[rows, f] > c]
                    if h[a].sum() >= 1 and h[b].sum() >= 1:
                        gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - total
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, b))
        if best[1] is None:
            out[rows] = g[rows].sum() / (h[rows].sum() + l2)
        else:
            for part in best[1]:
                grow(part, left - 1)

    grow(np.arange(len(x)), depth)
    return out


def test_trees_against_all_cuts():
    """With as many bins as values every cut is tried, so boosting gives the same scores as the plain loop."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7)).astype(float)
    y[rng.random(300) < 0.05] = 1
    model = boost(x, y, trees=4, depth=2, rate=0.3, bins=400)
    score = np.full(300, model.base)
    for _ in range(4):
        p = 1 / (1 + np.exp(-score))
        score += 0.3 * plain_tree(x, y - p, p * (1 - p), 2, 2.0)
    assert np.allclose(model.probabilities(x), 1 / (1 + np.exp(-score)), atol=1e-9)


def test_weights_and_a_single_class():
    x = np.array([[0.0], [0.0], [1.0], [1.0]] * 20)
    y = np.array([0, 1, 1, 1] * 20)
    heavy = boost(x, y.astype(float), trees=20, weight=np.where((x[:, 0] == 0) & (y == 0), 9.0, 1.0))
    light = boost(x, y.astype(float), trees=20)
    assert heavy.probabilities(np.array([[0.0]]))[0] < 0.3 < light.probabilities(np.array([[0.0]]))[0]
    assert boost(x, np.ones(80), trees=3).probabilities(x).min() > 0.9
    assert (boost(x, y.astype(float)).leaf == boost(x, y.astype(float)).leaf).all()
