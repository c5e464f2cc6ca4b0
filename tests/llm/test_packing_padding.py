import random

from tilewright.llm import packing


def test_padding_is_to_the_longest_document(spark):
    r = random.Random(6)
    sizes = [r.randrange(300, 5000) for _ in range(60)] + [65_536 // 4 - 3] * 8
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    out = packing.pack(docs, buckets=4).toPandas()
    for width, g in out.groupby("padded_length"):
        assert width == g.n_tokens.max()
    lengths, count = packing.histogram(docs.selectExpr("size(split(trim(text), ' ')) n_tokens"))
    ends = packing.best_boundaries(lengths, count, 4)
    assert out.padded_length.sum() == sum(min(e for e in ends if e >= n) for n in sizes)
    assert lengths.tolist() == sorted(set(sizes)) and count.sum() == len(sizes)


def plain_boundaries(lengths, counts, buckets):
    """The programme as it is written down: all choices of the last boundary, the shorter of equal ones."""
    n = len(lengths)
    pad = lambda i, j: sum(c * (lengths[j - 1] - x) for x, c in zip(lengths[i:j], counts[i:j], strict=True))
    best, back = {0: 0}, []
    for _ in range(min(buckets, n)):
        at = {j: min((best[i] + pad(i, j), i) for i in range(j) if i in best) for j in range(1, n + 1)}
        best = {0: 0} | {j: c for j, (c, _) in at.items()}
        back.append(at)
    ends, j = [], n
    for at in reversed(back):
        if j:
            ends.append(lengths[j - 1])
            j = at[j][1]
    return sorted(ends)


def test_boundaries_are_those_of_the_plain_programme():
    r = random.Random(11)
    for _ in range(150):
        lengths = sorted(r.sample(range(1, r.choice([12, 40, 4000])), r.randrange(1, 12)))
        counts = [r.randrange(1, r.choice([2, 3, 50])) for _ in lengths]
        for k in (1, 2, 3, 8):
            assert packing.best_boundaries(lengths, counts, k) == plain_boundaries(lengths, counts, k)


def test_whole_result_against_a_plain_version(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.choice([0, 1, 3, 7, 40, 41, 200, 900])) for i in range(200)] + [(None, "w w"), (5, None), (7, "w " * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [len((t or "").split()) for _, t in rows]
    lengths = sorted(set(sizes) - {0})
    ends = plain_boundaries(lengths, [sizes.count(n) for n in lengths], 8)
    want, seen = [], {}
    for (i, t), n in sorted(zip(rows, sizes, strict=True), key=lambda x: (x[0][0] is not None, x[0][0], x[1])):
        if not n:
            want.append((i, 0, None, 0, None, None))
            continue
        width = min(e for e in ends if e >= n)
        per, at = max(1, 65_536 // width), seen.setdefault(width, 0)
        seen[width] += 1
        want.append((i, n, ends.index(width), width, at // per, at % per))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, packing.pack(docs).collect()), key=key) == sorted(want, key=key)
