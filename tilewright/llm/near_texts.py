"""MinHash near-dedup: an inverted join over signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import join_spread, materialise, min_label
from tilewright.llm.hashing import LOWER_ASCII, gram_hashes, mix64, texts_of, word_hashes, word_spans
from tilewright.llm.vectors import local_components

SHINGLE = 5
# Coordinates of a signature, matches a candidate needs, and the coordinates that are posted: two
# signatures with MATCHES equal coordinates have one among the first COORDS - MATCHES + 1 of them, in any
# order of all coordinate-value pairs. A pair at similarity 0.75 has fewer than 9 of 24 matches with a
# probability of about 1e-5.
COORDS, MATCHES = 24, 9
POSTED = COORDS - MATCHES + 1
# The sharper signature of the confirming step.
FINE, FINE_MATCHES = 64, 30
LIST_BLOCK = 512  # a longer posting list is dealt out in blocks of this size
SPREAD = 2  # of its long lists, the number that a document is linked in before components are known
FREQUENT = 10_000  # values held by more than 1 / FREQUENT of all classes: at most COORDS * FREQUENT of them
_RNG = np.random.default_rng(20240101)
_MUL = _RNG.integers(0, 2**64, FINE, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, FINE, dtype=np.uint64)


def shingles(text: bytes | None, both: bool = False):
    """Sorted distinct hashes of the 5-word shingles of a whole text; of all its words if it has fewer.

    With both: also a second, independent hash of each.
    """
    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return (np.zeros(0, np.uint64),) * 2 if both else np.zeros(0, np.uint64)
    body = b" ".join(words)
    start, end = word_spans(np.frombuffer(body, np.uint8))
    k = min(SHINGLE, len(start))
    one = gram_hashes(word_hashes(body, start, end, 1), k)
    if not both:
        return np.unique(one)
    one, at = np.unique(one, return_index=True)
    return one, gram_hashes(word_hashes(body, start, end, 2), k)[at]


def signature(s: np.ndarray, coords: int) -> np.ndarray:
    out = np.full(coords, 2**32 - 1, np.uint32)
    for x in range(0, len(s), 32_768):
        part = s[x : x + 32_768, None] * _MUL[:coords] + _ADD[:coords]
        out = np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n, digest of the whole set (over 128 bits a shingle), signature; digest is null for an empty set."""

    def run(batches):
        for b in batches:
            n, digest, sig = [], [], []
            for t in texts_of(b.column("text")):
                s, other = shingles(t, both=True)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes() + other.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, COORDS).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "th", "n", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n long, digest binary, sig binary")


def pairs_of(batches):
    """The coordinate-value pairs of each class, as coordinate * 2^32 + value."""
    for b in batches:
        if len(b):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            yield pa.RecordBatch.from_arrays([pa.array(((np.arange(COORDS, dtype=np.int64) << 32)[None, :] + sig.astype(np.int64)).ravel())], ["key"])


def posting(frequent: dict[int, int]):
    """Posts each class under its POSTED rarest coordinate-value pairs: the frequent ones come last."""
    known = np.array(sorted(frequent), np.int64)
    times = np.array([frequent[k] for k in known.tolist()], np.int64)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            keys = (np.arange(COORDS, dtype=np.int64) << 32)[None, :] + sig.astype(np.int64)
            weight = np.zeros(keys.shape, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                weight = np.where(known[at] == keys, times[at], 0)
            pick = np.argsort(weight, axis=1, kind="stable")[:, :POSTED]
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(keys, pick, 1).ravel()), pa.array(np.repeat(b.column("doc").to_numpy(), POSTED))], ["key", "doc"])

    return run


def bits(mask: np.ndarray) -> np.ndarray:
    return (mask[:, None] >> np.arange(COORDS)) & 1 == 1


def first_shared(same: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first coordinate that is equal and posted by both; COORDS where there is none."""
    both = same & a & b
    return np.where(both.any(-1), np.argmax(both, axis=-1), COORDS)


POST = "task int, key long, lo int, hi int, side int, mixed boolean, comp long, doc long, n long, small int, large int, sig binary"
MEMBER = "cluster long, coord int, late boolean, comp long, doc long, n long, small int, large int"


def candidates(t: pa.Table) -> pa.Table:
    """Members of the groups of candidates of a task's blocks of posting lists.

    Collisions are counted coordinate by coordinate; a pair is given up as soon as the coordinates left
    cannot bring it to MATCHES. A pair that shares a short list is looked at in the first such list alone,
    and a pair that shares long lists only in the first of those, once the components are known.
    """
    key, lo, hi, side, mixed, comp, doc, n, small, large = (t[c].to_numpy() for c in ("key", "lo", "hi", "side", "mixed", "comp", "doc", "n", "small", "large"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, COORDS)
    order = np.lexsort((side, mixed, hi, lo, key))
    key, lo, hi, side, mixed, comp, doc, n, small, large, sig = (x[order] for x in (key, lo, hi, side, mixed, comp, doc, n, small, large, sig))
    m = len(key)
    new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (mixed[1:] != mixed[:-1])]
    cut = np.flatnonzero(new)
    size = np.diff(np.r_[cut, m])
    of = np.cumsum(new) - 1
    coord = key >> 32
    late = lo >= 0  # blocks of a list that is looked at again
    by_coord = np.ascontiguousarray(sig.T)
    pair_a, pair_b = [], []

    def look(p, q):
        good = (doc[p] != doc[q]) & (comp[p] != comp[q]) & (100 * np.minimum(n[p], n[q]) >= 75 * np.maximum(n[p], n[q])) & (~mixed[p] | (side[p] != side[q]))
        p, q = p[good], q[good]
        count = np.zeros(len(p), np.int8)
        for c in range(COORDS):
            count += by_coord[c, p] == by_coord[c, q]
            if c >= COORDS - MATCHES and len(p):
                good = count + (COORDS - 1 - c) >= MATCHES
                p, q, count = p[good], q[good], count[good]
        same = sig[p] == sig[q]
        short = first_shared(same, bits(small[p]), bits(small[q]))
        far = first_shared(same, bits(large[p]), bits(large[q]))
        good = np.where(late[p], (short == COORDS) & (far == coord[p]), (short == COORDS) | (short == coord[p]))
        pair_a.append(p[good])
        pair_b.append(q[good])

    few = size[of] <= 64
    for d in range(1, 64):  # all short lists at once, by distance in the list
        p = np.flatnonzero(few[: m - d] & (of[: m - d] == of[d:])) if m > d else np.zeros(0, int)
        if not len(p):
            break
        look(p, p + d)
    for x, s in zip(cut[size > 64], size[size > 64], strict=True):
        step = max(1, 100_000 // s)
        for r in range(0, s, step):
            p, q = np.meshgrid(np.arange(x + r, x + min(s, r + step)), np.arange(x, x + s), indexing="ij")
            up = p < q
            look(p[up], q[up])
    p, q = np.concatenate([*pair_a, np.zeros(0, int)]).astype(int), np.concatenate([*pair_b, np.zeros(0, int)]).astype(int)
    root = local_components(m, p, q)
    member = np.unique(np.concatenate([p, q]))
    block = mix64((lo.astype(np.uint64) << np.uint64(32)) ^ hi.astype(np.uint64) ^ (mixed.astype(np.uint64) << np.uint64(31)))
    cluster = mix64(key[member].astype(np.uint64) ^ mix64(doc[root[member]].astype(np.uint64) + block[member]))
    cols = [cluster.view(np.int64), coord[member].astype(np.int32), late[member], comp[member], doc[member], n[member], small[member], large[member]]
    return pa.table([pa.array(c) for c in cols], names=[c.split()[0] for c in MEMBER.split(", ")])


def confirm(t: pa.Table) -> pa.Table:
    """Spanning edges (a, b) of the links of a task's groups: each is confirmed on full sets.

    Pairs are taken by falling estimate; those already connected are skipped, all others whose estimate
    could belong to a link are compared exactly.
    """
    cluster, coord, late, comp, doc, small, large = (t[c].to_numpy() for c in ("cluster", "coord", "late", "comp", "doc", "small", "large"))
    texts = list(texts_of(t["text"]))
    out_a, out_b = [], []
    order = np.lexsort((doc, cluster))
    cut = np.flatnonzero(np.r_[True, cluster[order][1:] != cluster[order][:-1]])
    for x, y in zip(cut, np.r_[cut[1:], len(order)], strict=True):
        idx = order[x:y]
        sets = [shingles(texts[i]) for i in idx]
        sig = np.stack([signature(s, FINE) for s in sets])
        n, m, c, again = np.array([len(s) for s in sets]), len(idx), coord[idx[0]], late[idx[0]]
        short, long = bits(small[idx]), bits(large[idx])
        root = np.unique(comp[idx], return_index=True, return_inverse=True)
        root = root[1][root[2]].tolist()
        groups = len(set(root))
        tops = []
        step = max(1, 50_000 // m)
        for r in range(0, m, step):
            same = sig[r : r + step, None, :] == sig[None, :, :]
            est = same.sum(2)
            a, b = n[r : r + step, None], n[None, :]
            p, q = np.nonzero((est >= FINE_MATCHES) & same[:, :, c] & (100 * np.minimum(a, b) >= 75 * np.maximum(a, b)))
            up = p + r < q
            p, q = p[up], q[up]
            near, est = same[p, q, :COORDS], est[p, q]
            first = first_shared(near, short[p + r], short[q])
            good = (first == COORDS) & (first_shared(near, long[p + r], long[q]) == c) if again else (first == COORDS) | (first == c)
            tops.append(np.stack([est[good], p[good] + r, q[good]]))
        est, p, q = np.concatenate(tops, axis=1)
        by = np.argsort(-est, kind="stable")

        def find(i):
            while root[i] != i:  # noqa: B023
                root[i] = root[root[i]]  # noqa: B023
                i = root[i]  # noqa: B023
            return i

        for i, j in zip(p[by].tolist(), q[by].tolist(), strict=True):
            if groups == 1:
                break
            a, b = find(i), find(j)
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[max(a, b)] = min(a, b)
                groups -= 1
                out_a.append(int(doc[idx[i]]))
                out_b.append(int(doc[idx[j]]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def members_of(posts: DataFrame, rows: int) -> DataFrame:
    """Candidates by signature within blocks of posting lists."""
    posts = posts.withColumn("task", F.pmod(F.xxhash64("key", "lo", "hi", "mixed"), F.lit(max(1, rows // 65_536))).cast("int"))
    return materialise(posts.select(*[c.split()[0] for c in POST.split(", ")]).groupBy("task").applyInArrow(candidates, MEMBER), "candidates")


def linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of candidates, confirmed on texts (doc, text), a table of few more documents than they are."""
    size = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, size[0] // 2_048, size[1] // 1_000_000)
    # always by shuffle: the members grow with the corpus
    group = texts.join(members.hint("merge"), "doc").withColumn("task", F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("int"))
    return materialise(group.groupBy("task").applyInArrow(confirm, "a long, b long"), "edges")


def again(live: DataFrame, parts: DataFrame, list_block: int) -> DataFrame:
    """Blocks of the long lists in which documents of several components meet.

    The largest component of a list is the main side: its documents meet the others, never each other. Both
    sides are dealt out in blocks of list_block, so a list of one component costs nothing and one with few
    other documents grows as its length.
    """
    comps = live.join(parts.select(F.col("id").alias("doc"), "component").hint("merge"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    comps = materialise(comps, "again")
    sizes = comps.groupBy("key", "comp").agg(F.count("*").alias("_n"))
    sides = sizes.groupBy("key").agg(F.max(F.struct("_n", "comp")).alias("_main"), F.sum("_n").alias("_all")).where(F.col("_all") > F.col("_main._n"))
    sides = sides.select("key", F.col("_main.comp").alias("_main"), F.ceil(F.col("_main._n") / list_block).alias("_a"), F.ceil((F.col("_all") - F.col("_main._n")) / list_block).alias("_b"))
    rows = comps.join(sides.hint("merge"), "key").withColumn("side", (F.col("comp") != F.col("_main")).cast("int"))
    block = F.pmod(F.xxhash64("doc", "key"), F.when(F.col("side") == 0, F.col("_a")).otherwise(F.col("_b"))).cast("int")
    rows = rows.withColumn("block", block)
    upto = lambda n: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: k)
    own = lambda lo, hi, side, mixed: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), side.cast("int").alias("side"), mixed.alias("mixed"))
    b, zero, one = F.col("block"), F.lit(0), F.lit(1)
    # other blocks meet one another as (lo, hi), and every block of the main side as (main block, own block)
    meet = F.transform(upto(F.col("_b")), lambda k: own(F.least(b, k), F.greatest(b, k), F.when(b <= k, zero).otherwise(one), k != b))
    cross = F.transform(upto(F.col("_a")), lambda k: own(k, F.lit(-1) - b, one, F.lit(True)))
    main = F.transform(upto(F.col("_b")), lambda k: own(b, F.lit(-1) - k, zero, F.lit(True)))
    dealt = rows.withColumn("_p", F.explode(F.when(F.col("side") == 0, main).otherwise(F.concat(meet, cross))))
    return dealt.select("key", "comp", "doc", "n", "small", "large", "sig", "_p.*")


def components(texts, classes: DataFrame, list_block: int) -> DataFrame:
    """(id, component) of the classes (doc, n, sig) that link; texts(owned) joins the text of each doc to owned."""
    total = classes.count()
    # every pair that several classes hold, with their number: pairs of one class are never posted
    held = classes.select("sig").mapInArrow(pairs_of, "key long").groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    held = materialise(held, "held")
    frequent = held.where(F.col("held") > max(list_block, total // FREQUENT)).toArrow()  # at most COORDS * FREQUENT rows
    frequent = dict(zip(frequent["key"].to_pylist(), frequent["held"].to_pylist(), strict=True))
    posts = classes.select("doc", "sig").mapInArrow(posting(frequent), "key long, doc long").join(held.hint("merge"), "key")
    coord = F.shiftright("key", 32).cast("int")
    posts = posts.withColumn("_bit", F.pow(F.lit(2.0), coord).cast("int"))
    long = F.col("held") > list_block
    mine = posts.groupBy("doc").agg(
        F.collect_list(F.struct("key", "held")).alias("_keys"), F.coalesce(F.sum(F.when(~long, F.col("_bit"))), F.lit(0)).cast("int").alias("small"),
        F.coalesce(F.sum(F.when(long, F.col("_bit"))), F.lit(0)).cast("int").alias("large"),
    )
    live = classes.join(mine.hint("merge"), "doc").select("doc", "n", "sig", "small", "large", F.explode(F.array_sort("_keys")).alias("_k")).select("doc", "n", "sig", "small", "large", "_k.*")
    live = materialise(live, "posts")
    place = F.pmod(F.xxhash64("doc", "key"), F.ceil(F.col("held") / list_block)).cast("int")
    # lists before this one among the document's long lists: only the first SPREAD are linked in now
    before = F.bit_count(F.col("large").bitwiseAND(F.pow(F.lit(2.0), F.shiftright("key", 32)).cast("int") - 1))
    now = live.where((F.col("held") <= list_block) | (before < SPREAD))
    now = now.withColumns({"lo": F.lit(-1), "hi": place, "side": F.lit(0), "mixed": F.lit(False), "comp": F.col("doc")})
    members = members_of(now, now.count())
    crowded = live.where(F.col("held") > list_block)
    # the texts that either pass needs cross the network once, and are kept
    some = materialise(texts(members.select("doc").union(crowded.select("doc")).distinct()).select("doc", "text"), "texts")
    edges = linked(members, some)
    parts = min_label(edges)
    if crowded.isEmpty():
        return parts
    more = materialise(again(crowded, parts, list_block), "crowded")
    found = linked(members_of(more, more.count()), some)
    return parts if found.isEmpty() else min_label(edges.unionByName(found))


def near_duplicates(docs: DataFrame, list_block: int = LIST_BLOCK) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id, kept.

    docs has doc_id and text; other columns are ignored. ASCII letters are lower-cased; a set holds the
    distinct shingles of five words of the whole text, or all its words as one if it has fewer; null texts
    and texts without words have empty sets and link with nothing, as do rows of a null doc_id (kept,
    their component null). Documents link at a Jaccard similarity of 0.75 or more. Equal sets are one
    class before any posting; rows of one doc_id are documents of their own, kept if their component's
    smallest doc_id is theirs.

    Short posting lists are merged whole. Of a long one, documents are first linked within random blocks;
    then only pairs of unlike components are looked at again, so no link between components is lost.
    """
    return judged(docs, list_block).drop("th")


def judged(docs: DataFrame, list_block: int = LIST_BLOCK) -> DataFrame:
    """near_duplicates() with th, the hash of the row's text: (doc_id, th) tells unlike rows of a doc_id apart."""
    every = materialise(describe(docs), "signatures")
    full = every.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("sig").alias("sig"), F.count("*").alias("copies"))
    classes = materialise(classes.select("digest", "n", "rep.*", "sig", "copies", F.monotonically_increasing_id().alias("doc")), "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")

    def texts_for(owned: DataFrame) -> DataFrame:
        return texts.join(owned.join(classes.select("doc", "doc_id", "th").hint("merge"), "doc").hint("merge"), ["doc_id", "th"])

    parts = components(texts_for, classes.select("doc", "n", "sig"), list_block)
    lows = classes.join(parts.hint("merge"), classes["doc"] == parts["id"]).select("digest", "n", "doc_id", "component")
    least = materialise(lows.groupBy("component").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "least")
    total = every.count()
    lows = join_spread(lows, least, ["component"], total).select("digest", "n", "low")
    done = classes.select("digest", "n", F.col("doc_id").alias("rep"), "copies").join(lows.hint("merge"), ["digest", "n"], "left")
    done = materialise(done.select("digest", "n", F.coalesce("low", "rep").alias("low"), "copies"), "done")
    out = join_spread(every.select("doc_id", "th", "n", "digest"), done, ["digest", "n"], total)
    out = out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
