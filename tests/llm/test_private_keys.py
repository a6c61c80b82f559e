"""Private keys: the whole key is the span and the value, whatever else shares its header."""

import base64
import random

import duckdb
from pyspark.sql import functions as F
from test_secrets import brute, run

import corpus_pipeline
from flowsieve.llm.queries import QUERIES
from flowsieve.llm.sql import SQL

BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


def key(seed, end=True, line="\n", size=600, extra=""):
    body = base64.b64encode(random.Random(seed).randbytes(size)).decode()
    lines = [BEGIN + extra, *[body[i : i + 64] for i in range(0, len(body), 64)], *[END] * end]
    return line.join(lines)


ENCRYPTED = key(5, extra="\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D\n")
SHAPES = [
    key(1), key(1, line="\r\n"), key(1, line="\\n"), key(1, line='\\n" +\n  "'), key(1, line="\n> "), key(1, line=" "), ENCRYPTED,
    key(2, end=False), key(2, end=False, line="\\n"), key(3, end=False, size=601), key(4, end=False, size=48), key(6, size=30_000),
]


def test_whole_keys_are_spans(spark):
    texts = [f"ein Wort. {shape}{tail}" for shape in SHAPES for tail in ("", ". Then prose.", "\n\nThen prose goes on", "\n" + key(9))]
    rows = [(i, t, f"s{i}", "en", None) for i, t in enumerate(texts)]
    found = {r.doc_id: [s for s in r.spans if s.kind == "pem"] for r in run(spark, rows).collect()}
    for i, text in enumerate(texts):
        shape = SHAPES[i // 4]
        assert (found[i][0].start, found[i][0].end) == (10, 10 + len(shape)), text
        assert len(found[i]) == 1 + (i % 4 == 3)
        assert [(s.start, s.place, s.kind, s.end) for s in found[i]] == [x for x in brute(text) if x[2] == "pem"]


def test_long_bodies_need_no_stack(spark):
    texts = [key(1, size=3_000_000), key(1, end=False, size=3_000_000), BEGIN + " \n" * 500_000, BEGIN * 20_000]
    found = run(spark, [(i, t, "s", "en", None) for i, t in enumerate(texts)]).collect()
    ends = {r.doc_id: [s.end for s in r.spans if s.kind == "pem"] for r in found}
    assert ends[0] == [len(texts[0])] and ends[1] == [len(texts[1])]
    assert ends[2] == [len(BEGIN)] and len(ends[3]) == 20_000


def test_different_keys_of_many_owners_are_live(spark):
    """A header many owners have says nothing of the key; a key many owners have is an example."""
    rows = [(i, "x " + key(i, end=i % 2) + "\n\nprose", f"s{i}", "en", None) for i in range(12)]
    rows += [(100 + i, "y " + key(99), f"s{i}", "en", None) for i in range(4)]
    found = {r.doc_id: [(s.kind, s.live, s.owners) for s in r.spans] for r in run(spark, rows).collect()}
    assert all(found[i] == [("pem", True, 1)] for i in range(12))
    assert all(found[100 + i] == [("pem", False, 4)] for i in range(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, spans string")
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secrets_are_masked(spark, docs, "").collect()}
    assert all(masked[i] == ("x [SECRET]\n\nprose", 17) for i in range(12))
    assert all(masked[100 + i][0] == "y " + key(99) for i in range(4))


def test_query_matches_sql(spark, tmp_path):
    texts = [f"{a} {shape}{b}" for a in ("", "wort") for shape in SHAPES for b in (".", "\n\nprose", "\n" + key(7))]
    rows = [(i, t, f"s{i % 7}", f"l{i % 3}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = database.execute(SQL["op8_secrets"])
    columns = [d[0] for d in result.description]
    found = QUERIES["op8_secrets"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(result.fetchall())
