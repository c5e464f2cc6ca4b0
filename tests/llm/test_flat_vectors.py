import numpy as np
import pytest

from tilewright.llm import near_vectors


@pytest.mark.parametrize("data", [[[1.0, 2.0], [1.0, 2.1]], [[1.0], [2.0]], [[1.0, 2.0], [1.0, 2.1], [3.0], [4.0]]])
def test_links_of_one_or_two_components_count_once(spark, data):
    rows = [(i, 0, v) for i, v in enumerate(data)]
    got = near_vectors.link(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, 1, i // 2 * 2) for i in range(len(data))]


def brute(rows, threshold=0.93):
    x = np.array([v for _, _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    near &= np.array([[a[1] == b[1] for b in rows] for a in rows])
    np.fill_diagonal(near, False)
    low = np.array([i for i, _, _ in rows])
    for _ in rows:
        low = np.array([min([low[i], *low[np.flatnonzero(near[i])]]) for i in range(len(rows))])
    return sorted((i, int(near[k].sum()), int(low[k])) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_links_of_doubles_and_of_repeated_ids(spark, kind):
    r = np.random.default_rng(9)
    base = r.normal(size=(12, 8))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.1, base[:4]]).astype(np.float32)
    rows = [(int(i) // 2 if i < 6 else int(i), 1, [float(c) for c in v]) for i, v in enumerate(x)]
    got = near_vectors.link(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")).collect()
    assert sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in got) == brute(rows)


@pytest.mark.parametrize("polytopes, tables", [(1, 8), (2, 14), (3, 24), (4, 40)])
def test_recall_at_each_setting(spark, polytopes, tables):
    r = np.random.default_rng(polytopes)
    base = r.normal(size=(60, 64))
    noise = r.normal(size=(60, 64)) * np.linspace(0.05, 0.4, 60)[:, None]
    x = np.concatenate([base, base + noise])
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)]
    got = near_vectors.link(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), polytopes=polytopes, tables=tables).collect()
    found, all_ = sum(g["n_links"] for g in got), sum(n for _, n, _ in brute(rows))
    assert all_ > 80 and found <= all_ and found / all_ >= 0.95
