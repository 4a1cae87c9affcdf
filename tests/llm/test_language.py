import zlib

import pytest

from roadledger.llm import language as L
from roadledger.llm.queries import QUERIES


def test_query_on_held_out_rows(spark, data_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, data_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_learning_ignores_held_out_rows_and_labels_do_not_score(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'xx', lang) AS lang")
    one, two = L.fit(docs), L.fit(other)
    assert one.languages == two.languages and (one.weights == two.weights).all()


def test_families():
    assert L.family_of("de") == L.family_of("en-GB") == "germanic" and L.family_of("fr") == "romance"
    assert L.family_of("tlh") == "only tlh"


@pytest.mark.parametrize("known", [True, False])
def test_edges(spark, known):
    rows = [(i, t, l if known else None, "x") for i, (t, l) in enumerate([("the of and", "en"), ("der die das", "de"), ("le la les", "fr")] * 6)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "1234 !!", None, "x"), (None, "the and", "en", "x"), (103, "the of\n" * 20_000, None, "x")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, lang string, score string")
    model = L.fit(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predictions(docs, model).collect()]
    assert len(got) == len(rows) + 2
    by_id = {k: (name, score) for k, name, score in got}
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0)
    assert by_id[103][0] == ("en" if known else "und")
    assert L.predictions(docs.limit(0), model).count() == 0
