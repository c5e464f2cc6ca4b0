import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tilewright.llm import secrets

P = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in P.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = [
    None, "", "plain words", "é password = 'abcdef' and API_KEY:\"xyz123_=\" tail", "secret=token:abcdef123", "token: ab, TOKEN=abcdef",
    "AKIA" + "A1B2" * 4 + " é AKIAX", "0123456789abcdef" * 3 + "g", "deadbeefdeadbeefdeadbee", "password:" + "AKIA" + "Z9" * 10,
    "\U0001f600 secret = deadbeefdeadbeefdeadbeef " * 3, "passwd==" + "x" * 5000, " " * 3000 + "apikey=abcdef",
    "key Zq8vX2mK9pL4tR7wB1nC6yD3fG5hJ0sA and antidisestablishmentarianismus",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")], "doc_id long, text string, spans string")


def test_base_spans_match_brute_force(docs):
    rows = secrets.scan_secrets(docs, ["doc_id", "text"]).select("doc_id", "text", F.to_json("base").alias("b"), "base", "spans").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        base = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
        assert base == brute(r["text"]), r["text"]
        assert set(base) <= {(s["start"], s["kind"], s["end"]) for s in r["spans"]}


def test_random_tokens_are_told_from_words(docs):
    rows = secrets.scan_secrets(docs).where("doc_id = 13").collect()
    found = [TEXTS[13][s["start"] : s["end"]] for s in rows[0]["spans"]]
    assert found == ["Zq8vX2mK9pL4tR7wB1nC6yD3fG5hJ0sA"]


def test_battery_agrees_with_plain_python(spark):
    token = "Zq8vX2mK9pL4tR7wB1nC6yD3fG5hJ0sA"
    alphabet = secrets.ALPHABETS["base62"][1]
    v = [alphabet.index(c) for c in token]
    n, k = len(v), 62
    chi = sum(v.count(x) ** 2 for x in set(v)) * k / n - n
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5
    bits = [x >= k // 2 for x in v]
    ones, runs = sum(bits), 1 + sum(a != b for a, b in zip(bits, bits[1:], strict=False))
    mean = 2 * ones * (n - ones) / n + 1
    z_runs = (runs - mean) / ((mean - 1) * (mean - 2) / (n - 1)) ** 0.5
    w = [x + 1 - (k + 1) / 2 for x in v]
    z_serial = (sum(a * b for a, b in zip(w, w[1:], strict=False)) / sum(x * x for x in w) + 1 / (n - 1)) * n**0.5
    from math import erfc

    tail = lambda x: erfc(x / 2**0.5) / 2
    want = min(1.0, 3 * min(tail(z), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial))))
    got = spark.createDataFrame([(token,)], "t string").select(secrets.p_value(F.col("t"))).first()[0]
    assert abs(got - want) < 1e-6


def test_redact_keeps_columns_and_clean_rows(docs):
    out = {(r["doc_id"], r["text"]) for r in secrets.redact(docs).collect()}
    assert (2, "plain words") in out and (0, None) in out
    assert not any("deadbeefdeadbeefdeadbeef" in (t or "") for _, t in out)
    assert secrets.redact(docs).columns == docs.columns


def test_query_columns(spark, docs, tmp_path):
    docs.drop("spans").write.parquet(str(tmp_path / "documents.parquet"))
    for r in secrets.op6_secrets(spark, str(tmp_path)).collect():
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute(TEXTS[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_empty_table(spark, docs):
    assert secrets.scan_secrets(docs.where("false")).count() == 0
