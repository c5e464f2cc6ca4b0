"""Secret scans: fixed patterns, and a randomness test battery for other tokens. Built-in expressions only.

A token is reported if the battery holds its characters to be uniform over its encoding, and if, among all
tokens of its length, it is a discovery against the hypothesis that it is ordinary text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import materialise

# The patterns of the three base kinds. Letters of the first are matched in either case.
ASSIGN = r"""[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"""
ASSIGN = rf"""({ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex", "random")

# Tokens that the battery looks at, the encodings it infers (first that fits) and its levels.
PADDING = r"(?:={1,6}(?![A-Za-z0-9+/_=-]))?"  # of the end; within a token '=' stands between a name and a value
TOKEN = r"[A-Za-z0-9+/_-]{20,}" + PADDING
MIXED = r"[+/].*[_-]|[_-].*[+/]"  # fits no encoding
PARTS = tuple(c + "{20,}" + PADDING for c in ("[A-Za-z0-9_-]", "[A-Za-z0-9+/]", "[A-Za-z0-9]"))
ALPHABETS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "upper hex": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "lower base32": ("^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    "base36": ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower base36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": ("^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
STRATA = (20, 28, 40, 64)  # lower ends of the length strata, each with a false-discovery level of its own
FDR = 0.05
UNIFORM = 0.01  # the battery's level: a token it rejects is not random
# Letters of text in four languages (English, German, French, Spanish) in percent, rounded.
LETTERS = {
    "a": 8.8, "b": 1.5, "c": 3.2, "d": 4.5, "e": 14.3, "f": 1.5, "g": 1.6, "h": 3.2, "i": 7.0, "j": 0.4, "k": 0.6, "l": 4.4, "m": 2.7,
    "n": 7.6, "o": 6.0, "p": 2.2, "q": 0.6, "r": 6.7, "s": 7.2, "t": 6.6, "u": 4.6, "v": 1.2, "w": 1.1, "x": 0.3, "y": 0.8, "z": 0.6,
}
# Styles of ordinary tokens, by the share of capitals among their letters: joined words, names of constants, camel case.
STYLES = (0.03, 0.97, 0.2)
DIGITS, MARKS = 0.06, 0.06  # of all characters: 0-9 and +/_-
SPREAD = 2.0  # the variance of a token's surprisal against that of as many independent letters: words repeat and cluster
BINS_PER_DECADE, MOST_DECADES = 100, 40


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(text: Column, pattern: str, found: Column, keep, kind: str, block: int = 256) -> Column:
    """array<struct<start,end,kind,token>> of matches that keep(match) holds of, in code points.

    The pieces between the matches give the places: one pass, however many matches there are. Places are
    added up within blocks of matches and then over the blocks, so no long array is copied for each match.
    """
    order = KINDS.index(kind)
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("hit"))
    span = lambda start, x: F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("token"))
    one = "struct<start:int,kind:int,end:int,token:string>"
    empty = F.array().cast(f"array<{one}>")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"]) + F.length(x["hit"])).alias("at"),
        F.when(keep(x["hit"]), F.array_append(acc["out"], span(acc["at"] + F.length(x["piece"]), x))).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    short = F.aggregate(both, start, step, lambda acc: acc["out"])
    blocks = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(b, k * block + 1, F.lit(block)), start, step))
    moved = lambda acc, x: F.transform(x["out"], lambda y: F.struct((y["start"] + acc["at"]).alias("start"), y["kind"].alias("kind"), (y["end"] + acc["at"]).alias("end"), y["token"].alias("token")))
    outer = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{one}>>").alias("out"))
    joined = lambda b: F.flatten(F.aggregate(blocks(b), outer, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], moved(acc, x)).alias("out")), lambda acc: acc["out"]))
    return F.when(F.size(found) > block, let(both, joined)).when(F.size(found) > 0, short).otherwise(empty)


def parts(token: Column) -> Column:
    """The token's span, or, of one that fits no encoding, the spans of its parts between separators.

    Parts are the longest runs of base64url, of base64 and of letters and digits, so they may overlap.
    """
    every = lambda m: F.lit(True)
    inner = F.array_distinct(F.concat(*[spans(token["token"], p, matches(token["token"], p), every, "random") for p in PARTS]))
    moved = F.transform(inner, lambda s: F.struct((token["start"] + s["start"]).alias("start"), s["kind"].alias("kind"), (token["start"] + s["end"]).alias("end"), s["token"].alias("token")))
    return F.when(token["token"].rlike(MIXED), moved).otherwise(F.array(token))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (a public rational approximation, error below 1e-7)."""

    def tail(t: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly

    near = let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z)), tail)
    return F.when(z >= 0, near).otherwise(F.lit(1.0) - near)


def p_value(token: Column) -> Column:
    """Combined p-value of the battery under the hypothesis that the token's characters are drawn uniformly.

    Chi-squared over the alphabet (Wilson-Hilferty), runs above and below the middle of the alphabet, and
    lag-1 correlation of the code values; the least of the three, times three. A token that fits no
    encoding has p-value 0, as has one of a single half of the alphabet.
    """

    def battery(x: Column) -> Column:
        v, k = x["codes"], x["k"].cast("double")
        n = F.size(v).cast("double")
        count = lambda c: F.size(F.filter(v, lambda y: y == c)).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, c: acc + let(count(c), lambda m: m * m))
        high = F.transform(v, lambda y: (y > k / 2).cast("int"))
        ones = F.aggregate(high, F.lit(0.0), lambda acc, y: acc + y)
        pairs = lambda w, f: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), f)
        turns = F.aggregate(pairs(high, lambda a, c: (a != c).cast("int")), F.lit(0.0), lambda acc, y: acc + y)
        centred = F.transform(v, lambda y: y.cast("double") - (k + 1) / 2)
        cross = F.aggregate(pairs(centred, lambda a, c: a * c), F.lit(0.0), lambda acc, y: acc + y)
        power = F.aggregate(centred, F.lit(0.0), lambda acc, y: acc + y * y)
        sums = F.struct(n.alias("n"), k.alias("k"), squares.alias("squares"), ones.alias("ones"), turns.alias("turns"), cross.alias("cross"), power.alias("power"))
        return let(sums, scores)

    def scores(x: Column) -> Column:
        n, k, df = x["n"], x["k"], x["k"] - 1
        chi = x["squares"] * k / n - n
        spread = F.lit(2.0) / (df * 9)
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
        mean = x["ones"] * (n - x["ones"]) * 2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.abs((x["turns"] + 1 - mean) / F.sqrt(var))
        z_serial = F.abs((x["cross"] / x["power"] + F.lit(1.0) / (n - 1)) * F.sqrt(n))
        least = F.least(let(z_chi, upper_tail), let(z_runs, upper_tail) * 2, let(z_serial, upper_tail) * 2)
        return F.when(k.isNull() | (n < STRATA[0]) | (var <= 0) | (x["power"] <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), least * 3))

    def encoded(body: Column) -> Column:
        alphabet = F.lit(None).cast("string")
        for fits, letters in reversed(ALPHABETS.values()):
            alphabet = F.when(body.rlike(fits), letters).otherwise(alphabet)
        return let(alphabet, lambda a: F.struct(F.length(a).alias("k"), F.transform(F.split(body, ""), lambda c: F.instr(a, c)).alias("codes")))

    return F.coalesce(let(let(F.regexp_replace(token, "=+$", ""), encoded), battery), F.lit(0.0))


def text_p_value(token: Column) -> Column:
    """p-value of the token under the hypothesis that it is ordinary text: the chance that text of its length is as surprising.

    The surprisal of a character is minus the logarithm of its share in text; a token's sum is held
    against the mean and variance of as many characters of text, by the normal distribution. Text is joined words, constants in
    capitals or camel case: the style that explains a token best counts.
    """
    total = sum(LETTERS.values())
    costs, scales = [], []
    for capitals in STYLES:
        share = {c: (1 - DIGITS - MARKS) * (1 - capitals) * v / total for c, v in LETTERS.items()}
        share |= {c.upper(): (1 - DIGITS - MARKS) * capitals * v / total for c, v in LETTERS.items()}
        share |= {c: DIGITS / 10 for c in "0123456789"} | {c: MARKS / 4 for c in "+/_-"}
        mean = -sum(q * math.log(q) for q in share.values())
        scales.append((mean, SPREAD * (sum(q * math.log(q) ** 2 for q in share.values()) - mean**2)))
        costs.append(F.array(F.lit(0.0), *[F.lit(-math.log(q)) for q in share.values()]))
    letters = "".join(share)
    places = F.transform(F.split(F.regexp_replace(token, "=+$", ""), ""), lambda c: F.instr(F.lit(letters), c) + 1)

    def least_surprising(at: Column) -> Column:
        n = F.size(at)
        sums = [F.aggregate(F.transform(at, _cost(cost)), F.lit(0.0), lambda acc, v: acc + v) for cost in costs]
        return F.least(*[(total_ - n * mean) / F.sqrt(n * var) for total_, (mean, var) in zip(sums, scales, strict=True)])

    return let(let(places, least_surprising), upper_tail)


def _cost(table: Column):
    return lambda k: F.element_at(table, k)


def stratum(token: Column) -> Column:
    s = F.lit(0)
    for k, low in enumerate(STRATA[1:], 1):
        s = F.when(F.length(token) >= low, F.lit(k)).otherwise(s)
    return s


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row: a struct of the columns `keep` of docs; base: array of base spans; tokens: array of (span, stratum, p).

    p is the p-value of "ordinary text", and 1 for a token that the battery does not hold to be random. The
    columns of docs stand inside row, so no name of theirs can clash with those used here.
    """
    found = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("_t"))
    found = found.select("*", matches(F.col("_t"), ASSIGN).alias("_a"), matches(F.col("_t"), ACCESS).alias("_k"), matches(F.col("_t"), HEX).alias("_h"), matches(F.col("_t"), TOKEN).alias("_r"))
    t = F.col("_t")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    long = lambda m: F.length(m) >= 20
    found = found.select(
        "row", spans(t, ASSIGN, F.col("_a"), value, "assign").alias("_a"), spans(t, ACCESS, F.col("_k"), long, "access").alias("_k"),
        spans(t, HEX, F.col("_h"), lambda m: F.lit(True), "hex").alias("_h"), F.flatten(F.transform(spans(t, TOKEN, F.col("_r"), lambda m: F.lit(True), "random"), parts)).alias("_r"),
    )
    found = found.select("row", F.concat("_a", "_k", "_h").alias("base"), F.col("_r"))
    apart = F.filter("_r", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    found = found.select("row", F.transform("base", lambda b: b.dropFields("token")).alias("base"), apart.alias("_r"))
    p = lambda r: F.when(p_value(r["token"]) > UNIFORM, text_p_value(r["token"])).otherwise(F.lit(1.0))
    tested = F.transform("_r", lambda r: F.struct(r["start"], r["kind"], r["end"], stratum(r["token"]).alias("stratum"), p(r).alias("p")))
    return found.select("row", "base", tested.alias("tokens"))


def bin_of(p: Column) -> Column:
    """Bin of a p-value by its logarithm, rounded towards 1."""
    most = F.lit(MOST_DECADES * BINS_PER_DECADE)
    return F.when(p <= 0, most).otherwise(F.least(most, F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int")))


def discovery_bins(scanned: DataFrame, fdr: float = FDR) -> list[int]:
    """For each length stratum, the bin from which on a token is a discovery: not ordinary text but a secret.

    Benjamini-Hochberg over all tokens of the stratum: of those reported, a share of fdr at most is
    expected to be ordinary text. Read off a histogram of log p-values (at most 4,000 bins a stratum), so
    no sort over all tokens is needed.
    """
    t = scanned.select(F.explode("tokens").alias("t")).select("t.stratum", "t.p")
    counts = t.groupBy("stratum", bin_of(F.col("p")).alias("bin")).count().collect()
    levels = []
    for s in range(len(STRATA)):
        mine = sorted(((r["bin"], r["count"]) for r in counts if r["stratum"] == s), reverse=True)
        m, seen, level = sum(n for _, n in mine), 0, MOST_DECADES * BINS_PER_DECADE + 1
        for b, n in mine:
            seen += n
            if 10 ** (-b / BINS_PER_DECADE) <= fdr * seen / m:
                level = b
        levels.append(level)
    return levels


def find(scanned: DataFrame, levels: list[int]) -> DataFrame:
    """Adds spans: base spans and the tokens that are discoveries, by start, then kind."""
    at = lambda t: F.element_at(F.array(*[F.lit(x) for x in levels]), t["stratum"] + 1)
    kept = F.transform(F.filter("tokens", lambda t: bin_of(t["p"]) >= at(t)), lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return scanned.withColumn("base", F.array_sort("base")).withColumn("spans", F.array_sort(F.concat("base", kept)))


def scanned_rows(docs: DataFrame, keep: list[str], fdr: float) -> DataFrame:
    scanned = materialise(scan(docs, keep), "secrets")
    return find(scanned, discovery_bins(scanned, fdr))


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """Columns `keep` (default doc_id) of docs, base and spans: arrays of (start, kind, end).

    docs has doc_id and text; a null text is empty; other columns are ignored unless kept, and columns
    named base or spans cannot be kept. Spans count code points, end exclusive; kind is a place in KINDS.
    Repeated rows are scanned each for itself.
    """
    keep = keep or ["doc_id"]
    if {"base", "spans"} & set(keep):
        raise ValueError("base and spans are columns of the result")
    return scanned_rows(docs, keep, fdr).select("row.*", "base", "spans")


def redact(docs: DataFrame, mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """docs with every span of its text replaced by the mark; overlapping spans become one.

    n_chars, if any, follows; all other columns, of whatever name, keep their values.
    """
    cols = docs.columns
    found = scanned_rows(docs, cols, fdr)
    t = F.col("row.text")
    # the stretches between spans, then one join: no text is copied for each span
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.array_append(acc["out"], F.struct(acc["at"].alias("lo"), s["start"].alias("hi")))).alias("out"),
    )
    gaps = F.aggregate("spans", start, step, lambda acc: F.array_append(acc["out"], F.struct(acc["at"].alias("lo"), F.length(t).alias("hi"))))
    done = F.array_join(F.transform(gaps, lambda g: F.substring(t, g["lo"] + 1, g["hi"] - g["lo"])), mark)
    found = found.select("row", (F.size("spans") > 0).alias("hit"), F.when(F.size("spans") > 0, done).otherwise(t).alias("clean"))
    values = []
    for c in cols:
        value = F.col("row")[c]
        if c == "text":
            value = F.col("clean")
        elif c == "n_chars":
            value = F.when(F.col("hit"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(value)
        values.append(value.alias(c))
    return found.select(*values)


def joined(spans_: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
