import zlib

import numpy as np
import pytest

from roadledger.llm import quality_classifier as Q
from roadledger.llm import text as W
from roadledger.llm.queries import QUERIES


def test_query_on_held_out_rows(spark, sf_dir="/root/testdata/sf0.01"):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op1_quality_classifier"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean(np.array(good) >= 0.3) > 0.97


def test_scores_equal_the_network_itself():
    """The table of logits against plain forward evaluation of mean embedding and softmax."""
    settings = Q.Settings(buckets=512, epochs=3)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["ab", "abc", "zz", "zz", "é1"], 9)) for _ in range(40)]
    feature = []
    for text in texts:
        found = W.words_of(text)
        owner, buckets = W.subword_buckets(found, settings.ngrams, settings.buckets)
        repeats = sum(a == b for a, b in zip(found, found[1:])) * settings.repeat_weight
        feature.append(np.concatenate([buckets, np.full(repeats, settings.buckets)]))
    pairs = [np.unique(f, return_counts=True) for f in feature]
    labels = np.array([t.startswith("zz") for t in texts], np.int64)
    model = Q.train(labels, [p[0] for p in pairs], [p[1].astype(np.float32) for p in pairs], 0.5, settings)
    wanted = [1 / (1 + np.exp(-(model.logits[f].mean(dtype=float) + model.bias))) for f in feature]
    assert np.allclose(Q.Scorer(model)([*texts, None])[:-1], wanted, atol=1e-5)


@pytest.mark.parametrize("labelled", [0, 1, 2])
def test_edges(spark, labelled):
    rows = [(i, "good words here" if i % 2 else "$$$ %%% &&&", i) for i in range(40)]
    rows += [(100, None, 0), (101, "", 0), (None, "good", 0), (102, "good words\n" * 20_000, 0)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, score int")
    marks = [(i, None if labelled == 0 else 1 if labelled == 1 else i % 2) for i in range(40)] + [(None, 0), (4, None)]
    marks += [(3, 1)] * (labelled > 0)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r.score for r in Q.scores(docs, model).collect()}
    assert Q.scores(docs, model).count() == len(rows) + 3
    assert got[100] == got[101] == model.prior
    if labelled == 2:
        assert got[1] > 0.5 > got[2] and got[102] > 0.5
        assert Q.accepted(docs, model, 0.5).filter("doc_id % 2 = 0 AND doc_id < 40").count() == 0
    else:
        assert set(got.values()) == {0.5 if labelled == 0 else 1.0}
    assert Q.accepted(docs, model, 0.0).columns == docs.columns
    assert Q.scores(docs.limit(0), model).count() == 0
