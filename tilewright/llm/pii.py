"""Personal data: fixed patterns as seeds, and identifiers that the contexts of the seeds give away. Built-in expressions only.

Bootstrapping: the words around seeds are lexical patterns. Patterns and identifiers form a bipartite graph; a
pattern is trusted as far as its identifiers are known to be of one kind, an identifier as far as its patterns are.
Rounds of both go on until no identifier is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import WORD, drop_scratch, join_spread, materialise
from tilewright.llm.secrets import let

# The four base kinds in order, as patterns that cannot backtrack over long runs: a match begins
# where the run of its first characters does, or where the last match ended (\G).
LOCAL, HOST = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@{HOST}(?:\.{HOST})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "context")
#: Texts without this character (a digit for "0") hold no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "0", "phone": "+"}

# Unseen identifiers: runs of these characters with a digit; kept if they hold 4 digits and are no longer than LONGEST.
ID = "A-Za-z@._+/#-"
CANDIDATE = rf"(?<![0-9{ID}])[{ID}]*+[0-9](?:[0-9{ID}]*[A-Za-z0-9])?"
DIGITS, LONGEST = 4, 64
CONTEXT = 64  # code points looked at on either side for the words of a pattern

SEEDS = 5  # distinct identifiers of one kind that a pattern needs
TRUSTED = 0.8  # their share of all of its identifiers (and one more) from which on it is used
ACCEPTED = 0.9  # an identifier's score from which on it is reported and counts as a seed
ROUNDS = 10


def scan(items: Column, zero: Column, step, emit, kind: str, block: int = 256) -> Column:
    """array<kind> of emit(acc, x) for each x in items, where acc starts as zero and becomes step(acc, x).

    Goes through blocks, so that no long array is copied for each item.
    """
    none = F.array().cast(f"array<{kind}>")
    within = lambda acc, k: F.aggregate(
        F.slice(items, k * block + 1, F.lit(block)), F.struct(acc.alias("acc"), none.alias("out")),
        lambda t, x: F.struct(step(t["acc"], x).alias("acc"), F.array_append(t["out"], emit(t["acc"], x)).alias("out")),
    )
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    all_ = F.aggregate(
        blocks, F.struct(zero.alias("acc"), F.array().cast(f"array<array<{kind}>>").alias("out")),
        lambda s, k: let(within(s["acc"], k), lambda r: F.struct(r["acc"].alias("acc"), F.array_append(s["out"], r["out"]).alias("out"))),
    )
    return F.when(F.size(items) > 0, F.flatten(all_["out"])).otherwise(none)


def located(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start,end,hit,left,right>> of the matches `found` of pattern, with CONTEXT of the text on either side, up to the next match."""
    n = F.size(found)
    pieces = F.split(text, pattern, -1)
    zipped = let(pieces, lambda p: F.arrays_zip(F.slice(p, F.lit(1), n).alias("before"), found.alias("hit"), F.slice(p, F.lit(2), n).alias("after")))
    short = F.transform(zipped, lambda x: F.struct(F.length(x["before"]).alias("gap"), x["hit"].alias("hit"), F.right(x["before"], F.lit(CONTEXT)).alias("left"), F.substring(x["after"], 1, CONTEXT).alias("right")))
    span = lambda acc, x: F.struct((acc + x["gap"]).alias("start"), (acc + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right"))
    kind = "struct<start:int,end:int,hit:string,left:string,right:string>"
    places = let(short, lambda s: scan(s, F.lit(0), lambda acc, x: acc + x["gap"] + F.length(x["hit"]), span, kind))
    return F.when(n > 0, places).otherwise(F.array().cast(f"array<{kind}>"))


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a text of digits holds."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return let(digits_of(hit), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits_of(hit)).between(9, 15)
    return F.lit(True)


def patterns_of(x: Column) -> Column:
    """Lexical patterns around a span: the two words before, one on either side, the two after; digits as 0."""

    def made(w: Column) -> Column:
        l, r = w["l"], w["r"]
        before, after = F.element_at(l, -1), F.element_at(r, 1)
        two = F.when(F.size(l) > 1, F.concat_ws(" ", F.element_at(l, -2), before, F.lit("_")))
        both = F.when((F.size(l) > 0) & (F.size(r) > 0), F.concat_ws(" ", before, F.lit("_"), after))
        next_ = F.when(F.size(r) > 1, F.concat_ws(" ", F.lit("_"), after, F.element_at(r, 2)))
        return F.filter(F.array(two, both, next_), lambda p: p.isNotNull())

    words = lambda side: F.regexp_extract_all(F.regexp_replace(F.lower(side), "[0-9]", "0"), F.lit(WORD), F.lit(0))
    return let(F.struct(words(x["left"]).alias("l"), words(x["right"]).alias("r")), made)


def marked(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row: a struct of the columns `keep` of docs; rid; base: array of (kind, start, end); marks: array of (start, end,
    kind, id, patterns), base spans and, of kind 4, unseen candidates that touch no base span."""
    found = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("_t"))
    t = F.col("_t")
    none = F.array().cast("array<string>")
    has = lambda c: t.rlike("[0-9]") if c == "0" else F.contains(t, F.lit(c))
    all_ = {**BASE, "context": CANDIDATE}
    needs = {**NEEDS, "context": "0"}
    found = found.select("row", "_t", *[F.when(has(needs[k]), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"_{k}") for k, p in all_.items()])
    long = lambda x: (F.length(x["hit"]) <= LONGEST) & (F.length(digits_of(x["hit"])) >= DIGITS)
    kept = lambda k: (lambda x: passes(k, x["hit"])) if k in BASE else long
    found = found.select("row", *[F.filter(located(t, p, F.col(f"_{k}")), kept(k)).alias(f"_{k}") for k, p in all_.items()])
    mark = lambda k: F.transform(f"_{k}", lambda x: F.struct(x["start"], x["end"], F.lit(KINDS.index(k)).alias("kind"), F.xxhash64(x["hit"]).alias("id"), patterns_of(x).alias("patterns")))
    found = found.select("row", F.array_sort(F.concat(*[mark(k) for k in KINDS])).alias("marks"))
    base = F.transform(F.filter("marks", lambda m: m["kind"] < len(BASE)), lambda m: F.struct(m["kind"], m["start"], m["end"]))
    # by start: the farthest end of a base span before, and from the other side the nearest start of one after
    seed, one = (lambda m: m["kind"] < len(BASE)), "struct<start:int,end:int,kind:int,id:bigint,patterns:array<string>>"
    flag = lambda m, bad: F.struct(m["start"], m["end"], F.when(~seed(m) & bad, F.lit(-1)).otherwise(m["kind"]).alias("kind"), m["id"], m["patterns"])
    left = scan(F.col("marks"), F.lit(0), lambda acc, m: F.when(seed(m), F.greatest(acc, m["end"])).otherwise(acc), lambda acc, m: flag(m, acc > m["start"]), one)
    right = lambda ms: scan(F.reverse(ms), F.lit(2**31 - 1), lambda acc, m: F.when(seed(m), F.least(acc, m["start"])).otherwise(acc), lambda acc, m: flag(m, acc < m["end"]), one)
    return found.select("row", F.monotonically_increasing_id().alias("rid"), F.array_sort(base).alias("base"), F.filter(let(left, right), lambda m: m["kind"] >= 0).alias("marks"))


def graph(found: DataFrame) -> DataFrame:
    """Edges (pattern, id, kind) of marked(), each once, of the patterns that enough identifiers share to be trusted one day."""
    edges = found.select(F.explode("marks").alias("m")).select(F.explode("m.patterns").alias("pattern"), F.col("m.id").alias("id"), F.col("m.kind").alias("kind"))
    edges = materialise(edges.groupBy("pattern", "id").agg(F.min("kind").alias("kind")), "edges")
    live = edges.groupBy("pattern").agg(F.count("*").alias("copies")).where(F.col("copies") >= SEEDS).withColumn("n", F.col("copies"))
    return materialise(join_spread(edges, live, ["pattern"], edges.count()).where("n is not null"), "graph")


def trusted(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """(pattern, kind, trust, copies) of the patterns that are trusted, given the accepted identifiers (id, kind, score, copies)."""
    known = join_spread(edges.where(F.col("kind") == len(BASE)).drop("kind"), accepted, ["id"], max(1, edges.count())).where("kind is not null")
    all_ = edges.where(F.col("kind") < len(BASE)).withColumn("score", F.lit(1.0)).unionByName(known.select("pattern", "id", "n", "kind", "score"))
    # the number of a pattern's identifiers, n, stands in each of its edges
    sums = all_.groupBy("pattern", "kind").agg(F.sum("score").alias("sure"), F.max("n").alias("copies"))
    sums = sums.withColumn("trust", F.col("sure") / (F.col("copies") + 1)).where((F.col("sure") >= SEEDS) & (F.col("trust") >= TRUSTED))
    return sums.select("pattern", "kind", "trust", "copies")


def learn(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, identifiers): trusted patterns and the identifiers they give away (id, kind, score, copies), after the last round.

    A pattern's trust in a kind is the summed score of its identifiers of that kind (a seed has 1) over their number and
    one; at least SEEDS must be summed. An identifier's score is 1 - product(1 - trust) over its trusted patterns of the
    kind that scores best; from ACCEPTED on it counts in the next round.
    """
    spark = edges.sparkSession
    accepted, count = spark.createDataFrame([], "id long, kind int, score double, copies long"), 0
    unseen = edges.where(F.col("kind") == len(BASE)).select("pattern", "id")
    total = max(1, unseen.count())
    for _ in range(rounds):
        patterns = materialise(trusted(edges, accepted), "patterns")
        met = join_spread(unseen, patterns, ["pattern"], total).where("kind is not null")
        scores = met.groupBy("id", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score"), F.count("*").alias("copies"))
        best = scores.where(F.col("score") >= ACCEPTED).groupBy("id").agg(F.max(F.struct("score", -F.col("kind"))).alias("best"), F.max("copies").alias("copies"))
        now = materialise(best.select("id", (-F.col("best.col2")).alias("kind"), F.col("best.score").alias("score"), "copies"), "accepted")
        if accepted.inputFiles():
            drop_scratch(accepted)
        accepted, before, count = now, count, now.count()
        if count == before:
            break
    return patterns, accepted


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row, base and spans (arrays of (kind, start, end) by kind, then start) of each row of docs."""
    found = materialise(marked(docs, keep), "marked")
    _, accepted = learn(graph(found))
    if accepted.isEmpty():
        return found.select("row", "base", F.col("base").alias("spans"))
    unseen = found.select("rid", F.explode("marks").alias("m")).where(F.col("m.kind") == len(BASE)).select("rid", "m.id", "m.start", "m.end")
    counts = materialise(unseen.groupBy("id").agg(F.count("*").alias("copies")).join(accepted.select("id", "kind"), "id"), "counts")
    hits = join_spread(unseen, counts, ["id"], max(1, unseen.count())).where("kind is not null")
    more = hits.groupBy("rid").agg(F.collect_list(F.struct(F.lit(len(BASE)).alias("kind"), "start", "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return found.select("row", "rid", "base").join(more, "rid", "left").select("row", "base", spans.alias("spans"))


def find_personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default doc_id) of docs, base and spans: arrays of (kind, start, end), by kind, then start.

    docs has doc_id and text; a null text is empty; other columns are ignored unless kept, and columns named base or spans
    cannot be kept. Spans count code points, end exclusive; kind is a place in KINDS; those of the last kind, context, were
    found by their contexts. Equal rows get a row each, and their identifiers count once. An empty table gives an empty one.
    """
    keep = keep or ["doc_id"]
    if {"base", "spans"} & set(keep):
        raise ValueError("base and spans are columns of the result")
    return find(docs, keep).select("row.*", "base", "spans")


def induced_patterns(docs: DataFrame) -> DataFrame:
    """The trusted patterns of docs: pattern, kind (a name), trust, n (distinct identifiers it holds)."""
    patterns, _ = learn(graph(materialise(marked(docs, ["doc_id"]), "marked")))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    return patterns.select("pattern", name.alias("kind"), "trust", F.col("copies").alias("n"))


def joined(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
