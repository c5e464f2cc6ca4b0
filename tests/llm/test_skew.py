"""Hot keys, colliding texts and incremental batches, each against a brute-force version."""

import hashlib
import random
import re

import pytest

from tests.llm.test_operators import words
from tilewright.llm import near_texts, near_vectors, substring, suffixes


def thue_morse(n, a, b):
    t = a
    while len(t) < n:
        t += t.translate(str.maketrans(a + b, b + a))
    return t


def by_windows(rows):
    """What op1 has to give, by plain means."""
    first, split = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in sorted(rows)]
    for i, w in split:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = set()
    for i, w in split:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.add((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def by_bytes(rows):
    seen, out = set(), set()
    for i, t in sorted(rows):
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        out.add((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    return out


@pytest.fixture(scope="module")
def footer():
    """A passage that a third of all documents end or go on with, each in surroundings of its own."""
    line = words(24, 77)
    rows = [(i * (1 if i % 2 else 5_000), words(20, i) + " " + line + (" " + words(15, 9_000 + i) if i % 4 else "")) for i in range(90)]
    return rows + [(1_000_000 + i, words(60, 400 + i)) for i in range(60)] + [(2_000_000, line * 2), (2_000_001, line + " " + line), (2_000_002, None)]


@pytest.mark.parametrize("hot", [3, 8_192])
def test_hot_anchors_lose_nothing(spark, footer, hot):
    docs = spark.createDataFrame(footer, "doc_id long, text string")
    assert {tuple(r) for r in substring.remove_repeats(docs, hot=hot).collect()} == by_windows(footer)
    assert {tuple(r) for r in suffixes.remove_repeats(docs, hot=hot).collect()} == by_bytes(footer)


def test_batches_added_to_a_saved_index(spark, footer, tmp_path):
    early = sorted(footer)[:70]
    late = [(4_194_304 + i, t) for i, (_, t) in enumerate(sorted(footer)[70:])]
    history, batch = (spark.createDataFrame(x, "doc_id long, text string") for x in (early, late))
    index = substring.FingerprintIndex(spark, 16)
    index.add(history)
    index.save(str(tmp_path / "index"))
    got = substring.add_batch(substring.FingerprintIndex.open(spark, str(tmp_path / "index")), history, batch).collect()
    assert {tuple(r) for r in got} == {r for r in by_windows(early + late) if r[0] >= 4_194_304}


def test_texts_made_to_collide_stay_apart(spark):
    one, other = thue_morse(2_048, "a", "b")[:2_048], thue_morse(2_048, "b", "a")[:2_048]
    tail = words(12, 5)
    docs = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{other} {tail}"), (4, one), (5, other)]
    got = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in substring.remove_repeats(got).collect()} == by_windows(docs)
    near = {r["doc_id"]: r["component_id"] for r in near_texts.near_duplicates(got).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}  # 8 of 10 shingles, all, none


@pytest.mark.parametrize("block", [4, 16, 512])
def test_long_posting_lists_lose_no_link(spark, block):
    r, rows = random.Random(8), []
    for g in range(4):  # groups of near copies; the first is a chain whose ends are not linked themselves
        base = words(120, 900 + g).split()
        for i in range((40, 25, 3, 1)[g]):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            if g == 0:
                w = w[i:] + words(i, 50).split()
            rows.append((len(rows) * 7, " ".join(w)))
    rows += [(10_000 + i, words(8, 3) + " " + words(6, 7_000 + i)) for i in range(30)] + [(0, "another row of the first doc_id")]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    part = [i for i, _ in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if part[i] != part[j] and 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    want = sorted((i, len(s), p, i == p) for (i, _), s, p in zip(rows, sets, part, strict=True))
    got = near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), list_block=block)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_crowded_classes_and_components(spark):
    """More rows of one text, and of one vector, than are sent to one task; and many unlike ones in one component."""
    base = words(60, 1).split()
    rows = [(i, " ".join(base)) for i in range(1_100)] + [(5_000 + i, " ".join([*base[:30], f"x{i}", *base[30:]])) for i in range(1_050)] + [(9_000 + i, words(30, 70 + i)) for i in range(5)]
    near = near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(near) == 2_155 and (near[near.doc_id < 9_000].component_id == 0).all() and (near[near.doc_id >= 9_000].kept).all()
    data = [(i, 1, [1.0, 2.0, 3.0]) for i in range(1_100)] + [(5_000 + i, 1, [1.0, 2.0 + i * 1e-5, 3.0]) for i in range(1, 1_051)] + [(9_000, 1, [-1.0, 0.5, 0.0])]
    got = near_vectors.link(spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")).toPandas()
    assert len(got) == 2_151 and (got[got.vec_id < 9_000].component_id == 0).all() and (got[got.vec_id < 9_000].n_links == 2_149).all()
    assert got[got.vec_id == 9_000].values.tolist() == [[9_000, 0, 9_000, True]]
