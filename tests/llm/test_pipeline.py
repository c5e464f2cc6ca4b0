import hashlib
import math
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import words
from tests.llm.test_packing_padding import plain_boundaries
from tests.llm.test_secrets import brute
from tilewright.llm import toxicity
from tilewright.llm.common import materialise


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, words(40, i) + (" idiot scum" if i % 4 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(400)]
    rows += [(1000, words(40, 1), "en", "s0", 0), (1001, words(40, 2) + " password=hunter22x", "en", "s1", 0), (1002, None, None, None, None), (1003, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    docs.where("doc_id < 400").selectExpr("doc_id", "1 as quality", "cast(doc_id % 4 = 0 as int) as toxic").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs.toPandas()
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    toxic = seen["toxicity"]
    assert list(toxic.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not toxic.text.str.contains("idiot", na=False).any() and len(toxic) == 304
    near = seen["near_dedup"]
    assert 1000 not in set(near.doc_id) and 1 in set(near.doc_id) and 1002 in set(near.doc_id) and near.doc_id.is_unique
    masked = seen["secrets"]
    assert len(masked) == len(near) and not masked.text.str.contains("hunter22x", na=False).any()
    mixed = seen["mixing"]
    assert list(mixed.columns) == list(toxic.columns) and mixed.doc_id.value_counts().max() <= 2
    total = sum(len(re.findall(r"\S+", t or "")) for t in masked.text)
    assert abs(sum(len(re.findall(r"\S+", t or "")) for t in mixed.text) - 1.5 * total) < 0.1 * total
    assert len(seen["packing"]) == len(mixed)


def plain_run(folder, spark):
    """All stages by plain means; only the weights of the classifier come from the operator."""
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    model = toxicity.train_on_fold(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    weight = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True))

    def score(text):
        at = set(toxicity.features((text or "").encode()).tolist())
        return 1 / (1 + math.exp(-sum(weight.get(i, 0.0) for i in at) - weight.get(1 << toxicity.DIM_BITS, 0.0)))

    rows = [r for r in rows if score(r["text"]) < 0.7]
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in r["text"] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(rows)))
    rows, sets = zip(*sorted(zip(rows, sets, strict=True), key=lambda x: x[0]["doc_id"]), strict=True)
    for _ in range(3):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    rows = [r for i, r in enumerate(rows) if low[i] == i]
    for r in rows:
        out, at = "", 0
        for start, _, end in brute(r["text"]):
            if start >= at:
                out += r["text"][at:start] + "[SECRET]"
            at = max(at, end)
        r["text"] = out + r["text"][at:] if at else r["text"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None]
    total, weights = {s: sum(size(r) for r in rows if r["source"] == s) for s in names}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    mixed = []
    for r in rows:
        rate = target[r["source"]] / total[r["source"]] if total[r["source"]] else 0.0
        more = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32 < rate - int(rate)
        mixed += [r] * (int(rate) + more)
    lengths = sorted({size(r) for r in mixed} - {0})
    ends = plain_boundaries(lengths, [sum(size(r) == n for r in mixed) for n in lengths], 8)
    packed, seen = [], {}
    for r in sorted(mixed, key=lambda r: r["doc_id"]):
        n = size(r)
        width = min(e for e in ends if e >= n) if n else 0
        at = seen.get(width, 0)
        seen[width] = at + 1
        per = max(1, 65_536 // max(width, 1))
        packed.append((r["doc_id"], n, ends.index(width) if n else None, width, at // per if n else None, at % per if n else None))
    return packed


def test_run_equals_a_plain_version(spark, folder):
    key = lambda x: tuple((v is not None, v) for v in x)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "bucket", "padded_length", "batch", "position").collect()), key=key)
    want = sorted(plain_run(folder, spark), key=key)
    assert len(got) > 300 and got == want


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id as _id", "1 as tokens", "2 as base", "3 as spans", "4 as _t", "5 as _copies", "6 as row", "7 as th", "8 as _toxicity_score", "9 as _n")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name)
        assert docs.columns == first
        assert docs.where("_id <=> doc_id and tokens = 1 and base = 2 and spans = 3 and _t = 4 and _copies = 5 and row = 6 and th = 7 and _toxicity_score = 8 and _n = 9").count() == docs.count() > 250


def test_unlike_rows_of_a_doc_id_stay(spark, folder):
    docs = spark.createDataFrame([(1, words(30, 1)), (1, words(30, 2)), (1, words(30, 2)), (2, words(30, 2)), (None, "x"), (None, "x")], "doc_id long, text string")
    kept = sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()))
    assert kept == sorted(map(str, [docs.collect()[0], docs.collect()[1], docs.collect()[4], docs.collect()[5]]))


def test_the_least_of_unlike_rows_stays_in_any_order(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "en", s, 39) for s in ("b", None, "a", "c")]
    kept = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept.append([tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()])
    assert kept[0] == kept[1] and len(kept[0]) == 1
