"""The bound on what the classifier learns from, and an index of fingerprints that outlives compaction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import words
from tilewright.llm import substring, toxicity


def test_repeated_rows_are_learnt_from_once(spark):
    rows = [(i, words(25, i) + (" scum of it" if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    many = docs.unionByName(docs.where("doc_id in (3, 4)").crossJoin(spark.range(2_000)).select("doc_id", "text"))
    one, more = toxicity.train(docs, labels), toxicity.train(many, labels)
    assert np.array_equal(one["at"], more["at"]) and np.allclose(one["w"], more["w"])
    # unlike rows of one doc_id are bounded as well: of 500, 2 * 5 are learnt from
    unlike = docs.unionByName(spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("scum row "), F.col("id")).alias("text")))
    few = toxicity.train(unlike, labels, max_per_class=5, least_docs=1)
    assert len(few["at"]) < 10 * 90


def texts(ids, seed):
    shared = words(40, 99, 50_000)
    return [(i, words(30, seed + i, 50_000) + (" " + shared if i % 2 else "")) for i in ids]


def test_an_index_opens_after_later_batches(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = substring.FingerprintIndex(spark, 16, bits=3)
    parts = [texts(range(k, k + 8), 7) for k in range(0, 40, 8)]
    index.add(frame(parts[0]))
    index.save(str(tmp_path / "index"))
    for k in (1, 2):
        index.add(frame(parts[k]))  # merges runs that the first manifest named
    history = frame(sum(parts[:3], []))
    again = substring.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert again.last == 23 and sum(r.count() for _, r in again.runs) == sum(r.count() for _, r in index.runs)
    got = substring.add_batch(again, history, frame(parts[3]))
    whole = substring.remove_repeats(frame(sum(parts[:4], []))).where("doc_id >= 24")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.where("n_removed > 0").count() == 4
    with pytest.raises(ValueError):
        substring.add_batch(again, history, frame(parts[1]))
    # a manifest that was not written to its end does not count
    (tmp_path / "index" / "version=99").mkdir()
    assert substring.FingerprintIndex.open(spark, str(tmp_path / "index")).last == 31
