"""Each operator against a brute-force version on small tables with nulls, ties, copies and empty texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import mixing, near_texts, near_vectors, packing, substring, suffixes, toxicity, warc
from tilewright.llm.ann import search

EMPTY = "doc_id long, text string, source string"


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}é" if r.random() < 0.2 else f"v{r.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = words(120, 1), words(40, 2)
    near = base.split()
    near[10] = "changed"
    out = [(1, base, "a"), (2, " ".join(near), "a"), (3, base, "b"), (4, None, None), (5, "", "b"), (6, "one  two\tthree", "c")]
    out += [(7, words(30, 3) + " " + passage, "a"), (8, passage + "\n" + words(50, 4), None), (9, "Heer " * 80, "b"), (10, "HEER " * 30, "b")]
    out += [(2000 + i, words(60, 50) + f" tail{i}", "hot") for i in range(30)]
    out += [(5000, words(9000, 7, 90_000), "long"), (5001, base.upper(), "c"), (5002, "a" * 400, "c"), (5003, "x\x00y é " * 60, "c"), (6, "one  two\tthree", "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names clash with those the operators use inside
    return spark.createDataFrame([(i, t, s, i % 3, "k") for i, t, s in rows], EMPTY + ", chunk long, task string")


def once(rows):
    return sorted({(i, t or "") for i, t, _ in rows})


def test_substring_matches_brute_force(spark, docs, rows):
    first, split = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in once(rows)]
    for i, w in split:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = set()
    for i, w in split:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.remove_repeats(docs, texts=True)
    assert {tuple(r)[:4] for r in got.collect()} == want
    assert got.count() == len(rows)
    with_null = docs.limit(0).unionByName(spark.createDataFrame([(None, words(120, 1), "a", 1, "k")], docs.schema))
    assert substring.remove_repeats(with_null).first()["n_removed"] == 0
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_suffixes_match_brute_force(docs, rows):
    seen, want = set(), set()
    for i, t in once(rows):
        b = t.encode()
        gone = set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        spans = sum(k - 1 not in gone for k in gone)
        want.add((i, len(b), len(gone), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    assert {tuple(r) for r in suffixes.remove_repeats(docs).collect()} == want
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_order_is_lexicographic():
    r = np.random.default_rng(0)
    t = np.concatenate([r.integers(97, 100, 3000, dtype=np.uint8), np.full(300, 98, np.uint8), r.integers(97, 100, 400, dtype=np.uint8)])
    wanted = np.zeros(len(t), bool)
    wanted[:-108] = r.random(len(t) - 108) < 0.7
    order = suffixes.suffix_order(t, wanted)
    cut = [t[i : i + 108].tobytes() for i in order]
    assert cut == sorted(cut) and set(order.tolist()) == set(np.flatnonzero(wanted).tolist())


def test_warc_round_trip(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "z" * 300_000, "\x00"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)] + [(9, None, "<p>é</p>"), (None, "u", "n")], "page_id long, url string, html string")
    bundles = warc.write_bundles(warc.mark_revisits(pages), frame_bytes=64, bundle_bytes=500)
    back = {r["page_id"]: r for r in warc.read_bundles(bundles).collect()}
    assert len(back) == 8
    assert back[0]["record_type"] == "response" and back[0]["html"] == "<p>é</p>" and back[0]["payload_bytes"] == 9
    assert (back[3]["record_type"], back[3]["refers_to"], back[3]["html"]) == ("revisit", 0, None)
    assert back[2]["refers_to"] == 1 and back[2]["payload_bytes"] == 0 and back[9]["refers_to"] == 0 and back[4]["html"] == html[4]
    ids = spark.createDataFrame([(warc.ID % 4,), (warc.ID % 9,)], "record_id string")
    assert {r["page_id"] for r in warc.lookup(bundles, ids).collect()} == {4, 9}
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages.limit(0)))).count() == 0
    apart = {r["page_id"]: r["record_type"] for r in warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages, min_bytes=1))).collect()}
    assert apart[2] == "response" and apart[3] == "revisit"


def test_vector_links_match_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 24))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.15, base[:5], np.repeat(base[:1], 20, 0), np.repeat(base[1:2], 300, 0) + r.normal(size=(300, 24)) * 0.2]).astype(np.float32)
    data = [(i, (int(i) % 2) if i % 11 else None, [float(c) for c in v]) for i, v in enumerate(x)]
    n = len(data)
    data += [(n, 0, None), (n + 1, 0, [0.0] * 24), (n + 2, 0, [float("nan")] * 24), (n + 3, 0, [None] + [1.0] * 23), (n + 4, 0, [1.0, 2.0]), (None, 0, [1.0] * 24), (n + 5, 1, [])]
    got = {r["vec_id"]: r for r in near_vectors.link(spark.createDataFrame(data, "vec_id long, label int, embedding array<float>"), block=100).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([-1 - i if d[1] is None else d[1] for i, d in enumerate(data[:n])])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    part = list(range(n))
    for _ in range(n):
        new = [min([part[i], *[part[j] for j in np.flatnonzero(link[i])]]) for i in range(n)]
        if new == part:
            break
        part = new
    for i in range(n):
        assert got[i]["n_links"] == link[i].sum() and got[i]["component_id"] == part[i] and got[i]["kept"] == (part[i] == i), i
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["component_id"] == n + k for k in range(6))
    assert len(got) == len(data)


def test_near_texts_match_brute_force(docs, rows):
    ids, sets = [], []
    for i, t in once(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t))
        ids.append(i)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(ids)))
    for _ in ids:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    want = {(i, len(s), ids[p], i == ids[p]) for i, s, p in zip(ids, sets, part, strict=True)}
    assert {tuple(r) for r in near_texts.near_duplicates(docs).collect()} == want
    assert near_texts.near_duplicates(docs.limit(0)).count() == 0


def test_search_recall_and_small_tables(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 20)) * r.uniform(0.5, 2, size=(1500, 1))
    x[7] = x[8] = x[9]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None), (9998, [0.0] * 20), (None, [1.0] * 20)], "vec_id long, embedding array<double>")
    got = search(data, data.where("vec_id % 20 = 0"), 20).toPandas()
    hit = 0
    for q, rows_ in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        hit += len(set(best) & set(rows_.vec_id))
        assert list(rows_["rank"]) == list(range(1, 21)) and np.allclose(rows_.score, score[rows_.vec_id])
    assert hit / (75 * 20) >= 0.9
    few = data.where("vec_id < 4")
    assert search(few, few, 20).count() == 12
    assert search(data.limit(0), data.limit(0), 20).count() == 0


def test_toxicity_learns_the_words(spark):
    r = random.Random(1)
    rows_ = []
    for i in range(900):
        w = words(40, i).split()
        toxic = int(i % 3 == 0)
        if toxic:
            w[r.randrange(40)] = r.choice(["Idiot!", "scum,"])
        rows_.append((i, " ".join(w), toxic))
    docs_ = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    model = toxicity.train_on_fold(docs_, docs_.select("doc_id", "toxic"))
    scored = toxicity.score(docs_.unionByName(spark.createDataFrame([(5000, None, 0), (None, "", 0)], docs_.schema)), model, ["doc_id", "toxic"])
    out = scored.select("doc_id", toxicity.held_out().alias("held"), "toxic", toxicity.SCORE).toPandas()
    held = out[out.held]
    assert len(out) == 902 and ((held[toxicity.SCORE] >= 0.7) == (held.toxic == 1)).mean() > 0.95
    assert out[toxicity.SCORE].between(0, 1).all()


def test_mix_targets_and_copies(spark, docs, rows):
    plan = mixing.mix(docs).toPandas()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    for _, r in plan.iterrows():
        s = r["source"] if isinstance(r["source"], str) else None
        assert abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] and 0 <= r["copies"] <= 2
    assert mixing.emit_copies(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_packing_is_optimal_and_within_budget(docs, rows):
    r = random.Random(2)
    lengths = np.array(sorted(r.sample(range(1, 80), 12)))
    counts = np.array([r.randrange(1, 30) for _ in lengths])

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))

    from itertools import combinations

    for k in (1, 2, 3, 5):
        best = min(padding([*c, lengths[-1]]) for c in combinations(lengths[:-1], k - 1))
        assert padding(packing.best_boundaries(lengths, counts, k)) == best
    out = packing.pack(docs, buckets=4, token_budget=256).toPandas()
    assert len(out) == len(rows)
    packed = out[out.bucket.notna()]
    assert (packed.n_tokens <= packed.padded_length).all() and out[out.n_tokens == 0].bucket.isna().all()
    for (_, batch), g in packed.groupby(["bucket", "batch"]):
        assert sorted(g.position) == list(range(len(g))) and (len(g) == 1 or g.padded_length.sum() <= 256)
    assert packing.pack(docs.limit(0)).count() == 0
