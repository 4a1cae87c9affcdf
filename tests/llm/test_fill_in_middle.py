import hashlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from roadledger.llm import checks
from roadledger.llm import fill_in_middle as M
from roadledger.llm.queries import QUERIES

TEXTS = [
    None, "", "a", "ab", "\n", "é😀\r\n\u2028x", "$1 \\2 {3}", "<P>", "x<S>y", "<M", "<", "P>", "<<P", "a<", "\x00\x85 b",
    "e\u0301😀👨‍👩‍👧", " ", "a" * 1023, "b" * 1024, "😀" * 1025, "c\n" * 5000,
]


def brute(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    ids = [None, 0, -5, 2**62, *range(1, 30)]
    return [(key, text, "t", 3) for key in ids for text in TEXTS] + [(7, "ab", "t", 3)] * 3


def test_against_brute_force_with_nulls_repeats_and_clashing_names(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int")
    found = M.transformed(docs).collect()
    wanted = sorted(((key, *brute(key, text)) for key, text, *_ in rows), key=str)
    assert sorted((tuple(r) for r in found), key=str) == wanted
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_restored_exactly(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int")
    back = M.transformed(docs).select("doc_id", M.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)


def test_very_long_text_and_empty_table(spark):
    text = "0123456789é\n" * 400_000
    docs = spark.createDataFrame([(k, text) for k in range(6)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in M.transformed(docs).collect()}
    for key, row in found.items():
        assert tuple(row)[1:] == brute(key, text)
    assert M.transformed(docs.limit(0)).count() == 0


def test_other_units(spark):
    """Grapheme clusters stay whole; lines that do not end belong to the suffix."""
    text = "e\u0301" * 1500 + "👨‍👩‍👧x\n"
    docs = spark.createDataFrame([(k, text) for k in range(40)], "doc_id bigint, text string")
    settings = M.Settings(unit=r"\X")
    found = M.transformed(docs, settings)
    assert {r.n for r in found.collect()} == {1503}
    back = found.select(M.restored(F.col("output"), F.col("form"), settings).alias("text"))
    assert {r.text for r in back.collect()} == {text}
    accents = found.filter("form <> 'plain'").select(F.regexp_replace("output", "<[PSM]>", "|").alias("cut")).collect()
    assert not any("|\u0301" in r.cut for r in accents)
    lines = M.transformed(docs.select("doc_id", F.lit("a\nb\nc").alias("text")), M.Settings(unit=r"(?:[^\n]*\n)"))
    assert {r.n for r in lines.collect()} == {2}


def test_settings(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(50)], "doc_id bigint, text string")
    assert {r.form for r in M.transformed(docs, M.Settings(plain_percent=100)).collect()} == {"plain"}
    assert {r.form for r in M.transformed(docs, M.Settings(plain_percent=0, spm_percent=100)).collect()} == {"spm"}
    with pytest.raises(ValueError):
        M.Settings(prefix="<P>", suffix="<<S>")
    with pytest.raises(ValueError):
        M.Settings(prefix="$p$")
    odd = M.Settings(prefix="$p.", suffix="(s)", middle="[m]", plain_percent=0)
    made = M.transformed(docs, odd)
    assert {r.t for r in made.select(M.restored(F.col("output"), F.col("form"), odd).alias("t")).collect()} == {"some text"}
    assert made.filter(F.contains("output", F.lit("$p."))).count() == 50


def test_no_python_and_no_shuffle_in_the_plan(spark, data_dir):
    plan = QUERIES["op11_fill_in_middle"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_checking_sql(spark, sf_dir):
    found = QUERIES["op11_fill_in_middle"](spark, sf_dir)
    assert differences(found, connect(sf_dir), checks.statements()["op11_fill_in_middle"]) == ""
