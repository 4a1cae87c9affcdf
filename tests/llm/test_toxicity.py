import math
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from roadledger.llm import text as W
from roadledger.llm import toxicity as X
from roadledger.llm.queries import QUERIES


def test_query_on_held_out_rows(spark, sf_dir="/root/testdata/sf0.01"):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def tokens(text):
    return [w.decode().lower().strip(X.EDGES.decode()) for w in W.words_of(text)]


def test_counts_and_ratios_against_brute_force(spark):
    rows = [(1, "You, idiot! the cat sat"), (1, "the idiot ran idiot ran"), (0, "the cat sat the cat ran"), (0, "A cat"), (0, "")]
    rows = [(label, text) for label, text in rows for _ in range(2)]  # copies add no continuation
    frame = spark.createDataFrame(rows, "label int, text string")
    counts = X.continuation_counts(frame)
    pairs = {c: {(a, b) for label, t in rows if label == c for a, b in zip([None, *tokens(t)], tokens(t))} for c in (0, 1)}
    wanted = {c: Counter(b for _, b in pairs[c]) for c in (0, 1)}
    vocabulary = sorted(set(wanted[0]) | set(wanted[1]))
    key = dict(zip(vocabulary, X.word_keys([w.encode() for w in vocabulary]).view("int64").tolist()))
    got = {r.word: (r.toxic, r.ordinary) for r in counts.collect()}
    assert got == {key[w]: (wanted[1][w], wanted[0][w]) for w in vocabulary}
    total = {c: sum(wanted[c].values()) for c in (0, 1)}
    types = {c: len(wanted[c]) for c in (0, 1)}

    def probability(c, w):
        n = Counter(wanted[c].values())
        d = min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2])))
        shared = ((wanted[0][w] > 0) + (wanted[1][w] > 0)) / (types[0] + types[1])
        return max(wanted[c][w] - d, 0) / total[c] + d * types[c] / total[c] * shared

    ratios = {r.word: r.ratio for r in X.log_ratios(counts, X.Settings(least_share=0, least_ratio=0)).collect()}
    for w in vocabulary:
        assert math.isclose(ratios[key[w]], math.log(probability(1, w) / probability(0, w)), abs_tol=1e-9)
    for c in (0, 1):  # probabilities and what is freed add up
        assert math.isclose(sum(probability(c, w) for w in vocabulary), 1, abs_tol=1e-9)


@pytest.mark.parametrize("labelled", ["none", "one class", "both"])
def test_edges(spark, labelled):
    rows = [(i, f"word{i} {'idiot' if i % 2 else 'friend'} x{i % 3}", 0.5) for i in range(60)]
    rows += [(100, None, 0.0), (101, "", 0.0), (None, "idiot", 0.0), (102, "and so on\n" * 20_000 + "idiot", 0.0), (103, "!!", 0.0)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, score double")
    marks = [] if labelled == "none" else [(i, i % 2 if labelled == "both" else 0) for i in range(60)] + [(3, 0 if labelled != "both" else 1)]
    labels = spark.createDataFrame(marks + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = X.fit(docs, labels)
    found = X.scores(docs, model)
    got = {r.doc_id: r.score for r in found.collect()}
    assert found.count() == len(rows) + 2
    assert got[100] == got[101] == got[103]
    if labelled == "both":
        assert got[5] > 0.5 > got[100] and got[4] < 0.5 and got[102] > 0.5
    else:
        assert set(got.values()) == {0.5 if labelled == "none" else 0.0}
    assert X.scores(docs.limit(0), model).count() == 0
    assert X.fit(docs.limit(0), labels).weights is None


def test_rare_and_weak_words_keep_their_ratios(spark):
    """No share of the counts and no size of the ratio decides whether a word is scored."""
    counts = [(1, 3, 3), (2, 1, 0), (3, 0, 2), (4, 3_000_000, 3_000_000), (5, 5, 4)]
    table = X.probabilities(spark.createDataFrame(counts, "word bigint, toxic bigint, ordinary bigint"))
    wanted = {r.word: math.log(r.toxic_p / r.ordinary_p) for r in table.collect()}
    assert {r.word for r in X.log_ratios(table.select("word", *X.CLASSES), X.Settings()).collect()} == set(wanted)
    rare, weak = X.word_keys([b"rare", b"weak"]).view("int64").tolist()
    table = spark.createDataFrame(
        [(rare, 3e-8, 1e-8, *[0.0] * 4), (weak, 0.2, 0.15, *[0.0] * 4)], "word bigint, " + ", ".join(f"{name} double" for name in X.WORDS)
    )
    pairs = spark.createDataFrame([], "before bigint, word bigint, toxic bigint, ordinary bigint")
    docs = spark.createDataFrame([(1, "rare weak unknown", None), (2, "", None), (3, None, None)], "doc_id bigint, text string, label int")
    got = {r.doc_id: r for r in X.evidence(docs, X.Model(table, pairs, (0.5, 0.5), 0.5, X.Settings())).collect()}
    assert math.isclose(got[1].mean, (math.log(3) + math.log(4 / 3)) / 3) and math.isclose(got[1].expression, math.log(3))
    assert got[2].mean == got[3].mean == got[2].expression == 0


def test_pair_probabilities_against_brute_force(spark):
    rows = [(1, "take the tram out back"), (1, "take the tram out back and the bus"), (0, "out of the tram"), (0, "take back the bus"), (0, "the bus is out")]
    rows += [(0, "the bus is out"), (1, None), (0, "")]
    pairs = X.pair_counts(spark.createDataFrame(rows, "label int, text string"))
    seen = {c: Counter((a, b) for label, t in rows if label == c for a, b in zip([None, *tokens(t)], tokens(t))) for c in (1, 0)}
    kinds = {c: Counter(b for _, b in seen[c]) for c in (1, 0)}

    def discount(numbers):
        n = Counter(numbers)
        return min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2])))

    def probability(c, v, w):
        d, total, types = discount(kinds[c].values()), sum(kinds[c].values()), len(kinds[c])
        shared = ((kinds[0][w] > 0) + (kinds[1][w] > 0)) / (len(kinds[0]) + len(kinds[1]))
        low = max(kinds[c][w] - d, 0) / total + d * types / total * shared
        after = [n for (a, _), n in seen[c].items() if a == v]
        d = discount(seen[c].values())
        return max(seen[c][v, w] - d, 0) / sum(after) + d * len(after) / sum(after) * low if after else low

    vocabulary = set(kinds[0]) | set(kinds[1])
    for c in (0, 1):  # probabilities add up after every word, seen there or not
        assert all(math.isclose(sum(probability(c, v, w) for w in vocabulary), 1) for v in [None, *vocabulary, "new"])
    model = X.Model(X.word_table(pairs), pairs, X.pair_discounts(pairs), 0.5, X.Settings())
    texts = [t for _, t in rows] + ["new words take out the bus back is and new", "tram"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "text", "cast(null as int) label")
    got = {r.doc_id: r for r in X.evidence(docs, model).collect()}
    for i, t in enumerate(texts):
        found = [math.log(probability(1, v, w) / probability(0, v, w)) if w in vocabulary else 0 for v, w in zip([None, *tokens(t)], tokens(t))]
        assert math.isclose(got[i].mean, sum(found) / max(len(found), 1), abs_tol=1e-9)
        assert math.isclose(got[i].expression, max(found, default=0), abs_tol=1e-9)


def test_an_expression_of_ordinary_words_is_toxic(spark):
    """Both classes have the same words equally often; only their order tells the classes apart."""
    rows = [(i, f"p{i % 7} green tree red car q{i % 5}" if i % 2 else f"p{i % 7} red tree green car q{i % 5}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    held = [r for r in X.scores(docs, X.fit(docs, labels)).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 60 and all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held)


def test_pair_keys_are_those_of_spark(spark):
    numbers = [(0, 1), (-1, 2**63 - 1), (-(2**63), 5), (1234567890123, -987654321)]
    wanted = spark.createDataFrame(numbers, "before bigint, word bigint").selectExpr("xxhash64(before, word) k").collect()
    before, word = (np.array(n, np.int64).view(np.uint64) for n in zip(*numbers))
    assert X.pair_keys(before, word).view(np.int64).tolist() == [r.k for r in wanted]


def test_all_training_rows_but_the_calibration_sample_are_counted(spark):
    rows = [(i, f"some words of text {'slur' if zlib.crc32(str(i).encode()) % 5 == 4 else 'oaf'}" if i % 2 else "some other words") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    model = X.fit(docs, labels, settings=X.Settings(calibration_rows=3))
    counted = model.pairs.groupBy().sum("toxic", "ordinary").first()
    trained = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert tuple(counted) == (5 * (sum(i % 2 for i in trained) - 3), 3 * (sum(1 - i % 2 for i in trained) - 3))
    slur = X.word_keys([b"slur"]).view("int64").tolist()[0]
    assert model.table.filter(f"word = {slur}").first().toxic > 0


def test_stretches_start_at_every_word():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 7, 8, 9, 40, 0, 23, 0])
    ratio = rng.normal(size=counts.sum())
    got = X.measures(ratio, counts, X.Settings(window=8))[:, X.MEASURES.index("stretch")]
    for value, text in zip(got, np.split(ratio, np.cumsum(counts)[:-1])):
        n = min(8, len(text))
        wanted = max((text[i : i + n].mean() for i in range(len(text) - n + 1)), default=0) if n else 0
        assert math.isclose(value, wanted, abs_tol=1e-9)
    run = np.array([5.0] * 8 + [0.0] * 8)  # the same passage, wherever it stands
    moved = [X.measures(np.concatenate([np.zeros(k), run]), np.array([k + 16]), X.Settings())[0, 1] for k in range(9)]
    assert np.allclose(moved, 5)


def test_slices_without_any_word(spark):
    pairs = X.pair_counts(spark.createDataFrame([(1, "an idiot"), (0, "a friend")], "label int, text string"))
    model = X.Model(X.word_table(pairs), pairs, X.pair_discounts(pairs), 0.25, X.Settings())
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " \n")], "doc_id bigint, text string").coalesce(1)
    got = X.scores(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"]
    assert all(r.score == 0.25 and all(r[name] == 0 for name in X.EVIDENCE) for r in got)


def test_a_task_holds_a_few_megabytes_of_words(monkeypatch):
    """Neither all words a task has met nor more than a slice of its text at once."""
    monkeypatch.setattr(X, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)), raising=False)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n:08x}" for n in rng.integers(0, 400_000, 500).tolist()) for _ in range(3200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3200)), pa.array(texts), pa.array([i % 2 for i in range(3200)])], names=["doc_id", "text", "label"])
    for run in (lambda batches: X._pair_rows(batches), lambda batches: X._sliced(5)(batches)):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 90e6


def test_waves_and_buckets_do_not_change_a_score(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i if i % 17 else None, " ".join(f"w{n}{'!' if i % 2 and n % 5 == 0 else ''}" for n in rng.zipf(1.3, 60).tolist())) for i in range(300)]
    rows += rows[:20] + [(900, None), (901, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    model = X.fit(docs, labels)
    table = lambda found: np.array(sorted((r.doc_id or -1, *map(float, r[1:])) for r in found.collect()))
    wanted = table(X.scores(docs, model))
    assert len(wanted) == len(rows) and len(np.unique(wanted[:, -1])) > 200
    monkeypatch.setattr(X, "WAVE_ROWS", 40)
    monkeypatch.setattr(X, "BUCKET_PAIRS", 20)
    monkeypatch.setattr(X, "MODEL_ROWS", 1000)
    monkeypatch.setattr(X, "ROWS_BYTES", 100)
    monkeypatch.setattr(X, "LOOKUP_CHARS", 2000)
    assert np.allclose(table(X.scores(docs, X.replace(model, packed=None))), wanted, rtol=0, atol=1e-9)


def test_no_shuffle_files_stay_after_scoring(spark):
    rows = [(i, f"some words of text {'oaf' if i % 2 else 'friend'} x{i % 9}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").cache()
    model = X.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int"))
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    before = {b for b in blocks() if b.startswith("shuffle_")}
    found = X.scores(docs, model).collect()
    assert len(found) == 60 and not {b for b in blocks() if b.startswith("shuffle_")} - before


def test_packed_numbers_come_back(spark):
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    for part in (keys, keys[::-1], keys[:1], keys[:0]):
        assert np.array_equal(X._unpack_keys(X._pack_keys(part)), part)
    for values in (rng.normal(size=(70, 6)), rng.integers(-(2**62), 2**62, (70, 2)), np.empty((0, 2), np.int64)):
        assert np.array_equal(X._unpack(X._pack(values), values.dtype.type, values.shape[1]), values)
    for bits in (0, 1, 7):
        edges = X._edges(keys, bits)
        assert edges[0] == 0 and edges[-1] == len(keys) and len(edges) == 2**bits + 1
        assert all((k >> np.uint64(64 - bits) if bits else 0) == b for b, (c, d) in enumerate(zip(edges, edges[1:])) for k in keys[c:d])


def test_first_slices_of_all_tasks_do_not_meet_in_one_bucket(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"]), pa.array([0])], names=["doc_id", "text", "label"])
    found = []
    for task in range(32):
        monkeypatch.setattr(X, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: task)))
        rows = pa.Table.from_batches(X._sliced(5)(iter([batch]))).to_pylist()
        found += [r["bucket"] for r in rows if r["body"] is not None]
    assert len(found) == len(set(found)) == 32


def test_tables_have_one_row_a_bucket(spark, monkeypatch):
    """However many tasks and parts they come from, so that what a wave reads does not grow with tasks times buckets."""
    rng = np.random.default_rng(6)
    rows = [(i % 2, " ".join(f"w{n}" for n in rng.integers(0, 900, 50).tolist())) for i in range(120)]
    pairs = X.pair_counts(spark.createDataFrame(rows, "label int, text string").repartition(6)).cache()
    monkeypatch.setattr(X, "MODEL_ROWS", 100)
    monkeypatch.setattr(X, "BUCKETS", 8)
    tables = X.packed(X.word_table(pairs), pairs)
    held = tables.rows.orderBy("bucket").collect()
    assert tables.bits == 3 and [r.bucket for r in held] == list(range(8))
    found = {(k, *v) for r in held for k, v in zip(*(x.tolist() for x in X._merged([r.pairs], np.int64, 2)))}
    wanted = pairs.selectExpr("xxhash64(before, word) k", "toxic", "ordinary").collect()
    assert found == {(r.k % 2**64, r.toxic, r.ordinary) for r in wanted} and len(wanted) > 1000
