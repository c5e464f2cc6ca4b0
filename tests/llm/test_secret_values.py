"""Random values behind names, in paths and in narrow alphabets."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tilewright.llm import secrets

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
BASE62 = DIGITS + UPPER + LOWER
FORMS = {
    "name=": ("AWS_KEY={}", BASE62 + "+/"), "sig=": ("https://x.org/a?sig={}&b=1", BASE62), "long name=": ("A_LONG_NAME_OF_SOME_SETTING={}", BASE62 + "-_"),
    "upper hex": ("sum {} ok", DIGITS + "ABCDEF"), "lower base32": ("id {}", LOWER + "234567"), "lower base36": ("id {}", DIGITS + LOWER), "upper base36": ("id {}", DIGITS + UPPER),
    "after a path": ("v1/users/+/{}", BASE62 + "-_"), "within a path": ("some-path/to_a/{}/raw_file", BASE62), "after a name": ("a_b-{}", BASE62 + "+/"),
}


@pytest.fixture(scope="module")
def found(spark):
    r, rows = random.Random(4), []
    for name, (form, letters) in FORMS.items():
        for _ in range(20):
            ends, marks = [c for c in letters if c.isalnum()], letters[62:]
            value = r.choice(ends) + "".join(r.choice(letters) for _ in range(36)) + r.choice(ends)
            value = value[:12] + marks[:1] + value[12:24] + marks[1:] + value[24:]
            rows.append((name, value, form.format(value)))
    rows += [("plain", "", w) for w in ("a" * 40, "path/to-the/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ababababababababababababababab", "THE_NAME_NAME_NAME_NAME_NAME=x") for _ in range(20)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, name string, value string, text string")
    return secrets.scan_secrets(docs, ["doc_id", "name", "value", "text"]).collect()


@pytest.mark.parametrize("name", FORMS)
def test_random_values_are_found_where_they_stand(found, name):
    mine = [r for r in found if r["name"] == name]
    hit = sum(any(r["value"] == r["text"][s["start"] : s["end"]] for s in r["spans"]) for r in mine)
    assert len(mine) == 20 and hit >= 16


def test_plain_parts_are_not_reported(found):
    assert not any(s["kind"] == 3 for r in found if r["name"] == "plain" for s in r["spans"])


def test_no_encoding_is_no_evidence(spark):
    assert spark.createDataFrame([("a_b/" * 8,), ("name=" * 8,)], "t string").select(secrets.p_value(F.col("t")).alias("p")).where("p > 0").count() == 0


def test_padding_belongs_to_the_end_of_a_token(spark):
    text = F.lit("see cGl8Zq8vX2mK9pL4tR7wB1nC6yD3== and Zq8vX2mK9pL4tR7wB1nC6yD3==next")
    hits = spark.range(1).select(secrets.spans(text, secrets.TOKEN, secrets.matches(text, secrets.TOKEN), lambda m: F.lit(True), "random").alias("s")).first()["s"]
    assert [(h["start"], h["end"], h["token"]) for h in hits] == [(4, 34, "cGl8Zq8vX2mK9pL4tR7wB1nC6yD3=="), (39, 63, "Zq8vX2mK9pL4tR7wB1nC6yD3")]


@pytest.mark.parametrize("low", secrets.STRATA)
def test_few_of_the_reported_are_ordinary_text(spark, low):
    """Labelled tokens: as many random ones as ordinary ones of joined words, by length."""
    r, words = random.Random(low), "the quick Brown fox jumps over a lazy dog while seven grey wolves watch from under old trees and many children sing about rivers Hinter dem grossen Haus steht eine alte Eiche pendant que nous mangeons una casa blanca cerca del mar".split()
    rows = []
    for i in range(300):
        text = ""
        while len(text) < low:
            text += r.choice(words) + r.choice(["", "", "_"])
        rows.append((i, text[: low + 4]))
        rows.append((10_000 + i, "".join(r.choice(BASE62) for _ in range(low + 4))))
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("size(spans) > size(base)").select("doc_id").collect()
    false, true = sum(g[0] < 10_000 for g in got), sum(g[0] >= 10_000 for g in got)
    assert false <= 0.05 * (false + true) and true >= 270


def test_many_matches_and_columns_of_any_name(spark):
    text = "password=hunter2x and some words é " * 2_000
    docs = spark.createDataFrame([(1, text, "t", [1], "b", "s", 7, len(text)), (2, None, None, None, None, None, None, None)], "doc_id long, text string, tokens string, base array<int>, _t string, spans string, row long, n_chars long")
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert out[1]["text"] == "[SECRET] and some words é " * 2_000 and out[1][2:7] == ("t", [1], "b", "s", 7) and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2][1:] == (None,) * 7
    base = secrets.scan_secrets(docs).where("doc_id = 1").first()["base"]
    assert [(b["start"], b["end"]) for b in base] == [(35 * k, 35 * k + 17) for k in range(2_000)]


STYLES = {
    "capitals": lambda r, w: "_".join(x.upper() for x in r.sample(w, r.randrange(3, 6))), "snake": lambda r, w: "_".join(x.lower() for x in r.sample(w, r.randrange(3, 7))),
    "camel": lambda r, w: "".join(x.capitalize() for x in r.sample(w, r.randrange(3, 7))), "path": lambda r, w: "/".join([*(x.lower() for x in r.sample(w, r.randrange(3, 6))), f"v{r.randrange(9)}"]),
    "numbered": lambda r, w: "-".join([*(x.lower() for x in r.sample(w, r.randrange(3, 6))), str(r.randrange(10, 2030))]),
}
WORDS = (
    "maximum index buffer length default timeout handler request session cookie filter window element context factory visible screen height margin padding border quality export import legacy version"
    " schema column vector matrix pixel kernel worker thread queue mutex socket proxy strasse zwischen gesellschaft wirklich zeitung schluessel quelque toujours beaucoup aujourdhui ventana izquierda quizas ejemplo"
).split()


@pytest.mark.parametrize("half", [True, False])
def test_plain_tokens_of_every_style(spark, half):
    """Under 5% of the reported are plain tokens if half of all are random, of each style; if none is, none is reported."""
    r, rows = random.Random(12), []
    for style, made in STYLES.items():
        tokens = [t for t in (made(r, WORDS) for _ in range(700)) if len(t) >= 20][:400]
        rows += [(style, False, t) for t in tokens]
        rows += [(style, True, "".join(r.choice(BASE62) for _ in t)) for t in tokens] if half else []
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, style string, secret boolean, text string")
    hit = [x for x in secrets.scan_secrets(docs, ["doc_id", "style", "secret"]).collect() if any(s["kind"] == 3 for s in x["spans"])]
    if not half:
        assert hit == []
        return
    for style in STYLES:
        false, true = (sum(x["style"] == style and x["secret"] == k for x in hit) for k in (False, True))
        assert false <= 0.05 * (false + true) and true >= 0.8 * sum(x[0] == style and x[1] for x in rows), (style, false, true)
