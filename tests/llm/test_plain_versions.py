"""Learning against a plain version of the same rule, and columns whose names clash."""

import math
import random

import numpy as np
import pytest

from tests.llm.test_operators import words
from tilewright.llm import mixing, toxicity, warc


def test_learning_equals_the_plain_rule():
    r = random.Random(2)
    bias = 1 << toxicity.DIM_BITS
    rows = [([*r.sample(range(50), 6), bias], r.randrange(2)) for _ in range(300)]
    model = toxicity.Ftrl()
    z, n = {}, {}
    for at, y in rows:
        gain = 5.0 if y else 1.0
        model.step(np.array(at), y, gain)
        w = {}
        for i in at:
            zi, l1 = z.get(i, 0.0), 0.0 if i == bias else model.l1
            w[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((model.beta + math.sqrt(n.get(i, 0.0))) / model.alpha + model.l2)
        g = gain * (1 / (1 + math.exp(-sum(w.values()))) - y)
        for i in at:
            old = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / model.alpha * w[i]
            n[i] = old + g * g
    assert np.allclose([model.z[i] for i in z], list(z.values()), rtol=1e-3, atol=1e-3) and np.allclose([model.n[i] for i in n], list(n.values()), rtol=1e-3)
    assert any(model.weights(np.array([i]))[0] for i in z)


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, words(20, i) + (" scum" if i % 3 == 0 else ""), "en", f"s{i % 2}", 0, "a", "b", 1.5, 2.5, [i], 7) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _copies string, _toxicity_score double, _score_text double, row array<int>, copies int")


def test_scores_of_any_columns_and_of_empty_tables(spark, clashing):
    labels = clashing.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    model = toxicity.train_on_fold(clashing, labels)
    rows = toxicity.score_rows(clashing, model, clashing.columns)
    assert sorted(rows.select("row.*").collect()) == sorted(clashing.collect())
    with pytest.raises(ValueError):
        toxicity.score(clashing, model, clashing.columns)
    assert toxicity.score(clashing.limit(0), model, ["doc_id"]).count() == 0
    none = toxicity.train_on_fold(clashing, labels.limit(0))
    assert {r[toxicity.SCORE] for r in toxicity.score(clashing, none, ["doc_id"]).collect()} == {0.5}
    few = toxicity.train(clashing, labels, max_bytes=2_000)
    assert len(few["at"]) < len(model["at"])


def test_copies_keep_columns_of_any_name(clashing):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(clashing).collect()}
    out = mixing.emit_copies(clashing)
    assert out.columns == clashing.columns
    assert sorted(out.collect()) == sorted(r for r in clashing.collect() for _ in range(plan[r["doc_id"]]))


def test_pages_with_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "u", "x", "a", "b", "c", 5), (2, "u", "x", "a", "b", "c", 5)], "page_id long, url string, html string, _sha string, _first string, refers_to string, _n int")
    out = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages))).collect()}
    assert out == {1: ("response", None), 2: ("revisit", 1)}
