"""Spelling variants, the conversation trie and personal data, each against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tilewright.llm import conversations, pii, spelling


@pytest.fixture()
def many_tasks(spark):
    """Keeps small shuffles in as many tasks as there are partitions, so that shards have seams."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, times):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        out[w] = (best if best and counts[best] >= times * n else None, n, len(others))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


def plain_words(rows, least, drop):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % drop == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def test_variants_match_brute_force(spark, many_tasks):
    r = random.Random(5)
    stems = ["".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "abcabcabcabc", "ÉTRANGER", "étranger"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = r.choice(stems[: 5 + r.randrange(40)])
            if r.random() < 0.4:
                k = r.randrange(len(w) + 1)
                w = w[:k] + r.choice(["", "a", "é", "Z"]) + w[k + r.randrange(2) :]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "÷", "_"]).join(words)))
    rows += [(None, "abcabcabcabc abcabcabcabd " * 4), (7, None), (8, ""), (9, "short"), (3, rows[3][1]), (900, " ".join(["q" * 4000 + "x", "q" * 4000 + "y", "q" * 2000 + "z" + "q" * 2000 + "x"] * 6))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node long, word string")
    want = plain_variants(plain_words(rows, 3, 7), 2)
    got = spelling.group_spellings(docs, least=3, times=2, drop_one_in=7).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert sum(1 for x in want if x[1]) > 10 and sum(1 for x in want if x[2] != (x[1] or x[0])) > 0
    assert spelling.group_spellings(docs.limit(0)).count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [x[3] for x in sorted(s)] for c, s in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        s = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_matches_brute_force(spark, many_tasks):
    r = random.Random(8)
    rows = []
    for c in [*range(0, 150), 1000, 1019, -25]:
        n = r.choice([1, 2, 3, 5, 22, 40]) if c % 20 else r.choice([0, 1, 2, 30])
        same = c % 3 == 0
        for k in range(n):
            text = f"turn {k} " + ("same" if same or r.random() < 0.7 else str(r.randrange(3)))
            rows.append((c, k, r.choice(["user", None]) if not same else "user", text))
    rows += [(5, None, "user", "first of all"), (5, None, "user", "first of all"), (6, 1, None, None), (6, 1, "", "x"), (None, 0, "user", "lost"), (41, 0, "a", None), (2001, 0, "user", "alone")]
    rows += [(3000 + i, k, "user", f"turn {k} same" + (f" {i}" if k == 25 else "")) for i in range(12) for k in range(28)]
    convs = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, key long, id string")
    assert sorted((tuple(x) for x in conversations.prefix_trie(convs).collect()), key=str) == plain_trie(rows)
    assert conversations.prefix_trie(convs.limit(0)).count() == 0
    one = spark.createDataFrame([(20, 0, "user", "x")], convs.schema.names[:4])
    assert [x["depth"] for x in conversations.prefix_trie(one.selectExpr("conv_id", "turn", "role", "text")).orderBy("depth").collect()] == [0, 1]


def test_blocks_of_a_shard_have_seams(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(conversations, "BLOCK_TURNS", 60)
    seqs = sorted({tuple(random.Random(i).choices(range(5), k=i % 6)) for i in range(200)})
    batch = pa.RecordBatch.from_arrays([pa.array([list(s) for s in seqs], pa.list_(pa.int64())), pa.array([[1] * len(s) for s in seqs], pa.list_(pa.int64())), pa.array([1] * len(seqs)), pa.array(range(len(seqs))), pa.array(["x"] * len(seqs))], names=["ids", "ws", "n", "low", "ends"])
    rows = [x for b in conversations._tries(iter([batch])) for x in b.to_pylist()]
    nodes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    alone = [x for x in rows if x["digest"] is None]
    assert len(alone) + len({x["digest"] for x in rows if x["digest"] is not None}) == len(nodes)
    assert sum(x["digest"] == b"" for x in rows) > 3 and alone


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0
    return {"ip": lambda: all(int(x.lstrip("0")[:4] or 0) <= 255 for x in hit.split(".")), "phone": lambda: 9 <= len(digits) <= 15}.get(kind, lambda: True)()


def base_spans(text):
    return [(k, m.start(), m.end()) for k, (name, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if holds(name, m[0])]


def test_base_spans_match_brute_force(spark):
    r = random.Random(4)
    cards = ["4111111111111111", "4111 1111-1111 1111", "4111111111111112", "41111111111111111111"]
    bits = ["a", "é", "@", ".", "-", "_", "%", " ", "1", "25", "255", "256", "007", "+", "(", ")", "b.c@d.e", "1.2.3.4", "+1 (743) 555-3824", "𝒳", "\n", *cards]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "a@b.c_d@e.f+1 2.3.4.5.6.7.8.9"), (903, "x" * 60_000 + "@" + "y." * 30_000 + "z 1" + " 2" * 30_000), (904, "9" * 200_000 + ".1.1.1"), (905, ("4111111111111111, " * 700) + "a@b.cd"), (901, "")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, rid long, kind string")
    got = sorted((x["doc_id"], [tuple(s) for s in x["base"]]) for x in pii.find_personal_data(docs).collect())
    assert got == sorted((i, sorted(base_spans(t))) for i, t in rows)
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pii.find_personal_data(docs, ["spans"])


def plain_learn(edges, rounds):
    of, accepted, patterns = defaultdict(set), {}, {}
    for p, i, k in edges:
        of[p].add((i, k))
    for _ in range(rounds):
        patterns = {}
        for p, es in of.items():
            sure = Counter()
            for i, k in es:
                if k < 4:
                    sure[k] += 1.0
                elif i in accepted:
                    sure[accepted[i][0]] += accepted[i][1]
            patterns |= {(p, k): s / (len(es) + 1) for k, s in sure.items() if s >= pii.SEEDS and s / (len(es) + 1) >= pii.TRUSTED}
        miss = defaultdict(lambda: 1.0)
        for (p, k), trust in patterns.items():
            for i, kind in of[p]:
                if kind == 4:
                    miss[i, k] *= 1 - trust
        before, accepted = len(accepted), {}
        for (i, k), m in miss.items():
            if 1 - m >= pii.ACCEPTED and (i not in accepted or (1 - m, -k) > (accepted[i][1], -accepted[i][0])):
                accepted[i] = (k, 1 - m)
        if len(accepted) == before:
            break
    return patterns, accepted


def test_learning_on_the_graph_matches_a_plain_version(spark):
    r = random.Random(6)
    seeds = {i: r.randrange(4) for i in range(150)}
    edges = set()
    for p in range(160):
        kind = r.randrange(4)
        mine = [i for i, k in seeds.items() if k == kind or r.random() < 0.01]
        edges |= {(f"p{p}", i, seeds[i]) for i in r.sample(mine, min(len(mine), r.randrange(2, 25)))}
        edges |= {(f"p{p}", 1000 + r.randrange(40) + 40 * kind, 4) for _ in range(r.randrange(4))}
    size = Counter(p for p, _, _ in edges)
    live = sorted(e for e in edges if size[e[0]] >= pii.SEEDS)
    table = spark.createDataFrame([(p, i, k, size[p]) for p, i, k in live], "pattern string, id long, kind int, n long")
    patterns, accepted = pii.learn(table)
    want_p, want_a = plain_learn(live, pii.ROUNDS)
    assert {(x["pattern"], x["kind"]): round(x["trust"], 9) for x in patterns.collect()} == {k: round(v, 9) for k, v in want_p.items()}
    assert {x["id"]: (x["kind"], round(x["score"], 9)) for x in accepted.collect()} == {i: (k, round(s, 9)) for i, (k, s) in want_a.items()}
    assert len(want_a) > 5


def test_contexts_give_identifiers_away(spark):
    r = random.Random(1)
    phone = lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    rows = [(i, f"{r.choice(['ja', 'oh', 'so'])} please call me at {phone()} before noon {i}") for i in range(30)]
    rows += [(100 + i, f"well please call me at {555000 + i}-22 before noon") for i in range(3)]
    rows += [(200 + i, f"order {70000 + i} was sent on day {i}") for i in range(40)] + [(300, "elsewhere 555001-22 stands alone"), (301, "a plain text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: [s for s in x["spans"] if s["kind"] == 4] for x in pii.find_personal_data(docs).collect()}
    text = dict(rows)
    assert {i: [text[i][s["start"] : s["end"]] for s in v] for i, v in found.items() if v} == {100: ["555000-22"], 101: ["555001-22"], 102: ["555002-22"], 300: ["555001-22"]}
    assert {"at _ before", "_ before noon"} <= {x["pattern"] for x in pii.induced_patterns(docs).collect() if x["kind"] == "phone"}
