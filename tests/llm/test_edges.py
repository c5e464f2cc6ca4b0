"""Inputs at the edges of what the operators promise, each against a brute-force version."""

import hashlib

import numpy as np
import pytest

from tilewright.llm import suffixes


def test_suffix_order_reaches_the_last_run():
    r = np.random.default_rng(1)
    for t in (np.full(300, 98, np.uint8), np.concatenate([r.integers(97, 100, 500, dtype=np.uint8), np.full(250, 98, np.uint8)]), np.frombuffer(b"ab" * 120, np.uint8)):
        wanted = np.zeros(len(t), bool)
        wanted[: len(t) - 99] = True
        order = suffixes.suffix_order(t, wanted)
        cut = [t[i : i + suffixes.WINDOW].tobytes() for i in order]
        assert cut == sorted(cut) and order.tolist() != [] and set(order.tolist()) == set(np.flatnonzero(wanted).tolist())


@pytest.mark.parametrize("texts", [["a" * 400], ["b" * 100 + "a" * 250, "z" * 30 + "b" * 150, "no repeat here"], ["x" + "=" * 180, "y" + "=" * 180], ["\x00" * 250]])
def test_runs_of_one_byte_are_removed(spark, texts):
    seen, want = set(), set()
    for i, t in enumerate(texts):
        b, gone = t.encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        want.add((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in suffixes.remove_repeats(docs).collect()} == want
