"""Spelling variants: words one edit apart, found by walking a relational trie with a frontier of states.

A state (word, position, node, edits) stands at a node of a trie of all words. The trie is a table of edges,
path-compressed: nodes are the prefixes at which words part and the words' ends. Level by level, states are
joined to the edges of their node; those that reach the end of another word with one edit are neighbours.

Two tries are walked, of the words and of the words reversed. An edit in the second half of a word is looked
for in the first, one in the first half in the second, so a state leaves its own path only where the trie has
become narrow; up to there the path of a word in the trie that holds it needs no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import drop_scratch, join_spread, materialise
from tilewright.llm.hashing import U64, mix64, powers

LETTERS = r"[A-Za-zÀ-ÿ]"
CAPITALS_APART = r"[À-Þ]"
END = "\0"  # ends every word in the trie; no letter


def spelled(docs: DataFrame, shortest: int, drop_one_in: int) -> DataFrame:
    """The words of docs, a row for each occurrence (column word).

    A maximal run of letters is lower-cased (A-Z only); with h the crc32 of "<doc_id>:<run>" (a null doc_id is empty),
    the run loses its code point h % length if drop_one_in divides h. Shorter runs than `shortest` cannot give a word.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    low = F.when(F.col("run").rlike(CAPITALS_APART), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower("run"))
    runs = runs.select("doc", low.alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    return hashed.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, drop_one_in: int = 199) -> DataFrame:
    """(word, n) of the words that occur at least `least` times, counted over all documents."""
    return spelled(docs, shortest, drop_one_in).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and both directions, the prefixes at which a state of it or of a near word may stand."""
    for batch in batches:
        ids, words = batch.column("vid").to_numpy(), batch.column("word").to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        for back in (False, True):
            text = "".join(w[::-1] for w in words) if back else "".join(words)
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            start = np.cumsum(size) - size
            at = np.arange(len(code)) - np.repeat(start, size)
            seed = U64(0x51ED270B2C5C1D3B if back else 0)
            total = np.zeros(len(code) + 1, U64)
            np.cumsum(mix64(code.astype(U64) + seed) * powers(int(size.max(initial=1)))[0][at], out=total[1:])
            low = size // 2 if back else (size - 1) // 2
            rows = size - low + 1
            word = np.repeat(np.arange(len(words)), rows)
            depth = np.arange(len(word)) - np.repeat(np.cumsum(rows) - rows, rows) + low[word]
            place = start[word] + depth
            node = mix64(total[place] - total[start[word]] + seed + depth.astype(U64))
            following = np.where(depth < size[word], code[np.minimum(place, max(len(code) - 1, 0))] if len(code) else 0, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[word]), pa.array(np.full(len(word), back)), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(following.astype(np.int32))],
                names=["vid", "back", "depth", "node", "following"],
            )


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, starts) of the two tries of words (vid, word, n).

    edges: (node, label, child, other, other_n, copies): `other` is the word that ends there, else null; copies is
    how many words pass the node. starts: (word, n, node, rest): where a word may take its edit, and what is left
    of it. A node is the 64-bit hash of its prefix: if two prefixes shared one, edges would be too many, never too
    few, and the check of each pair drops what does not belong.
    """
    rows = words.select("vid", "word").mapInArrow(_prefixes, "vid long, back boolean, depth int, node long, following int")
    rows = materialise(rows, "prefixes")
    nodes = rows.groupBy("node").agg(F.min("following").alias("a"), F.max("following").alias("b"), F.count("*").alias("copies"))
    nodes = materialise(nodes.where("a <> b").select("node", F.col("copies").alias("passing"), "copies"), "nodes")
    passed = join_spread(rows.select("vid", "back", "depth", "node"), nodes, ["node"], rows.count()).where("passing is not null")
    paths = passed.groupBy("vid", "back").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "passing"))).alias("at"))
    oriented = F.concat(F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")), F.lit(END))
    paths = paths.join(words, "vid").select("back", "word", "n", oriented.alias("s"), "at")
    paths = materialise(paths, "paths")
    following = lambda f: F.get("at", F.col("i") + 1)[f]
    steps = paths.select("word", "n", "s", "at", F.posexplode("at").alias("i", "here"))
    last = following("depth").isNull()
    edges = steps.select(
        F.col("here.node").alias("node"),
        F.substring("s", F.col("here.depth") + 1, F.coalesce(following("depth"), F.length("s")) - F.col("here.depth")).alias("label"),
        following("node").alias("child"), F.when(last, F.col("word")).alias("other"), F.when(last, F.col("n")).alias("other_n"), F.col("here.passing").alias("copies"),
    ).distinct()
    size = F.length("word")
    first = F.when(F.col("back"), F.floor((size + 1) / 2)).otherwise(F.floor(size / 2))
    starts = paths.select("word", "n", "s", F.explode(F.filter("at", lambda x: x["depth"] >= first)).alias("here"))
    starts = starts.select("word", "n", F.col("here.node").alias("node"), F.substring("s", F.col("here.depth") + 1, F.length("s")).alias("rest"))
    return materialise(edges, "edges"), starts


def tail(text: Column, start: Column | int) -> Column:
    """text from its code point `start` (from 0) on."""
    return F.substring(text, (start if isinstance(start, Column) else F.lit(start)) + 1, F.length(text))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words (distinct; word, n) that one edit parts, once.

    The pair is found from the shorter word by an insertion, or from the one whose letter is smaller by a replacement,
    so a state never needs a deletion.
    """
    words = materialise(words.select("word", "n", F.monotonically_increasing_id().alias("vid")), "words")
    edges, starts = trie(words)
    total = max(1, starts.count())
    met = join_spread(starts, edges, ["node"], total)
    label, rest = F.col("label"), F.col("rest")
    first, own, beyond = F.substring("label", 1, 1), F.substring("rest", 1, 1), tail(label, 1)
    replaced = F.when((own != END) & (first > own) & F.startswith(tail(rest, 1), beyond), tail(rest, F.length(label)))
    added = F.when(F.startswith(rest, beyond), tail(rest, F.length(label) - 1))
    left = F.explode(F.filter(F.array(replaced, added), lambda x: x.isNotNull()))
    columns = ["word", "n", F.col("child").alias("node"), "other", "other_n"]
    step = met.where((first != own) & (first != END)).select(*columns, left.alias("rest"))
    steps = [materialise(step, "step")]
    by_letter = edges.drop("copies").withColumn("letter", F.substring("label", 1, 1))
    while not (now := steps[-1].where(F.col("rest") != "")).isEmpty():
        now = now.select("word", "n", "node", "rest", F.substring("rest", 1, 1).alias("letter"))
        met = now.join(by_letter, ["node", "letter"]).where(F.startswith("rest", "label"))
        steps.append(materialise(met.select(*columns, tail(rest, F.length(label)).alias("rest")), "step"))
    pairs = reduce(DataFrame.unionByName, [s.where("rest = '' and other is not null") for s in steps])
    # an insertion next to equal letters may be met from both ends
    return pairs.select("word", "n", "other", "other_n").distinct().where(F.levenshtein("word", "other", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms followed to the last, twice as far in each round."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        after = materialise(now.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), "roots")
        drop_scratch(now)
        now = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """Each word with its form and root: word, form, root, n, n_near, form_n.

    words has word (distinct) and n. Two words are near if exactly one inserted, deleted or replaced code point parts
    them; a word's form is its near word of largest n (ties: first in code-point order) if that n is at least `times` its
    own; its root is the last of the forms that follow, or itself. An empty table gives an empty result.
    """
    pairs = neighbours(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    out = words.select("word", "n").join(best, "word", "left")
    good = -F.col("best.n") >= F.col("n") * times
    out = out.select("word", F.when(good, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.n")).alias("form_n"))
    out = materialise(out, "variants")
    out = out.join(roots(out.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, drop_one_in: int = 199) -> DataFrame:
    """variants() of the vocabulary of docs (doc_id, text; other columns are ignored, a null text has no words).

    Repeated rows count as often as they stand; a null doc_id is hashed as an empty one.
    """
    return variants(materialise(vocabulary(docs, shortest, least, drop_one_in), "vocabulary"), times)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents: word, form, root, n, n_near, form_n."""
    return group_spellings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The crc32 of UTF-8 bytes by its public table, which is made by rule; words one edit apart by what is left of
# them without one code point.
CRC32_SQL = """
bits(b, c) AS (SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256) r(b)),
crc_table(crcs) AS (SELECT list(c ORDER BY b) FROM bits)"""


def crc32_sql(hex_text: str) -> str:
    """DuckDB expression: the unsigned crc32 of bytes given as hex digits; crcs must be in scope."""
    codes = f"list_transform(range(0, len({hex_text}) // 2), lambda i: ('0x' || substr({hex_text}, 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: xor(crcs[xor(c & 255, x) + 1], c >> 8)), 4294967295)"


OP13_SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
told AS (SELECT run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, k, {crc32_sql("hx")} AS h FROM told, crc_table),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1),
v AS (SELECT word, n FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, min({{'n': -other_n, 'other': hex(encode(other)), 'word': other}}) AS b FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.n >= 5 * v.n THEN b.word END AS form, CASE WHEN -b.n >= 5 * v.n THEN -b.n END::BIGINT AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk(word, stop) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.stop WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.stop AS root FROM walk w JOIN formed f ON f.word = w.stop WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
