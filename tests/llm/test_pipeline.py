"""The pipeline against brute-force versions of its stages, and the contract of the entry file."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import test_decontaminate
import test_line_dedup
import test_minhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from roadledger.llm import quality_classifier


def test_stages_against_brute_force(spark, sf_dir="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = {r.doc_id: r.score for r in quality_classifier.scores(docs, quality_classifier.fit(docs, labels)).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    keep = {k for k in rows if score[k] >= 0.3}
    texts = {k: (rows[k].source, rows[k].text) for k in keep}
    kept = {k: t for k, _, _, t in test_line_dedup.brute([(k, *v) for k, v in texts.items()], 0.1, 5)}
    first = {k for k, n, c in test_minhash.brute(sorted(kept.items()), 5) if k == c or n == 0}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {k: kept[k] for k in first}
    held = test_decontaminate.brute(sorted(left.items()), items)
    left = {k: t for k, t in left.items() if k not in held}
    assert len(keep) < len(rows) and len(first) < len(kept) and held

    pieces = defaultdict(list)
    total = 0
    for p in entry.queries()["pipeline"](spark, sf_dir).collect():
        pieces[p.doc_id].append(p)
        total += p.length
    assert set(pieces) == set(left)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, text in left.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[k], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    assert {p.sequence_id for own in pieces.values() for p in own} == set(range(-(-total // 4096)))


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString(), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_one_query_for_each_operator():
    numbers = [name.split("_")[0] for name in entry.queries() if name.startswith("op")]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
