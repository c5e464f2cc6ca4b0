import numpy as np

from tilewright.llm import ann


def test_a_query_in_a_small_list_gets_k_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = np.eye(8) * 10
    of = np.r_[np.zeros(5, int), np.ones(8, int), r.integers(2, 8, 987)]
    x = centres[of] + r.normal(size=(1000, 8)) * 0.1
    most = float(np.sqrt((x * x).sum(1).max()))
    # what fit() gives where nearly all sampled neighbours lie in the own list
    monkeypatch.setattr(ann, "fit", lambda sample, rows, k: (ann.lifted(centres, most), 1, most))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(data, data.where("vec_id < 15"), 20).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * 15
