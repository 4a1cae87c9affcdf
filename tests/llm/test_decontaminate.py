import random
import re
from collections import Counter

import pytest

from roadledger.llm import decontaminate as D
from roadledger.llm.queries import QUERIES


def shingles(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    """doc_id -> {item_id: best similarity}, over all stretches."""
    out = {}
    wanted = {i: shingles(t) for i, t in items}
    for doc_id, text in docs:
        s = shingles(text)
        for item, b in wanted.items():
            if not b or not set(b) & set(s):
                continue
            best = 0
            for start in range(max(1, len(s) - len(b) + 1)):
                a = s[start : start + len(b)]
                both = sum((Counter(a) & Counter(b)).values())
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    best = max(best, both / (len(a) + len(b) - both))
            if best:
                out.setdefault(doc_id, {})
                out[doc_id][item] = max(best, out[doc_id].get(item, 0))
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    wanted = brute(docs, items)
    assert wanted
    rows = {r.doc_id: r for r in QUERIES["op4_decontamination"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for doc_id, r in rows.items():
        found = wanted.get(doc_id, {})
        assert (r.contaminated, r.n_items, r.item_ids) == (bool(found), len(found), ",".join(map(str, sorted(found))))
        assert abs(r.similarity - max(found.values(), default=0)) < 1e-12


def test_edited_passages(spark):
    """Items of many sizes with words changed, dropped, added, moved and cut off."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 6, 9, 15, 22, 37, 59, 80, 240])]
    items += [(50, "same same same same same same same same"), (51, "a b c"), (52, None), (53, items[4][1])]
    docs = []
    for doc_id in range(120):
        w = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(0, 3)):
            if w:
                at = rng.randrange(len(w))
                edit = rng.randrange(4)
                w = [w[:at] + [word()] + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + [word()] + w[at:], w[at:] + w[:at]][edit]
        before, after = ([word() for _ in range(rng.randrange(0, 30))] for _ in range(2))
        docs.append((doc_id, rng.choice([" ", ", ", "\n"]).join(before + [x.title() for x in w] + after)))
    docs += [(400, None), (401, ""), (402, "a b c"), (403, "same " * 3_000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in D.contaminated(frame, bench).collect()}
    wanted = brute(docs, items)
    assert {k: r.items for k, r in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert all(abs(r.similarity - max(wanted[k].values())) < 1e-12 for k, r in got.items())


def test_blocks_cover_the_fingerprint(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(63)
        flips = sum(1 << b for b in rng.sample(range(63), 20))
        rows.append((a, a ^ flips))
    frame = spark.createDataFrame(rows, "a bigint, b bigint")
    shared = frame.select(D.F.size(D.F.array_intersect(D._blocks("a", 20), D._blocks("b", 20))).alias("n"))
    assert shared.agg({"n": "min"}).first()[0] >= 1


def test_nulls_repeats_empty_tables_and_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "x"), (1, text, "x"), (1, "else", "y"), (None, text, "z"), (2, "nothing here at all to see", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    bench = spark.createDataFrame([(7, text), (8, text), (None, text)], "item_id bigint, text string")
    assert [(r.doc_id, r.items, r.similarity) for r in D.contaminated(docs, bench).collect()] == [(1, [7, 8], 1.0)]
    left = D.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.fingerprint for r in left.collect()) == ["w", "z"]
    assert D.clean(docs, bench.limit(0)).count() == 5 and D.clean(docs.limit(0), bench).count() == 0


def test_no_python_in_the_plan(spark, data_dir):
    docs, bench = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert "Python" not in D.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()


def test_long_repeats_and_many_items_of_one_size(spark):
    """Work grows with the text and with the alike pairs, not with items times stretches."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(2_000)]
    docs = [(k, " ".join([word(), items[k][1], word()])) for k in range(500)] + [(900, " ".join([items[7][1]] * 500))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.items, r.similarity) for r in D.contaminated(frame, bench).collect()}
    assert got == {**{k: ([k], 1.0) for k in range(500)}, 900: ([7], 1.0)}
    keys = D.item_keys(D.benchmark_items(bench, D.Settings()), D.Settings())
    assert keys.groupBy("item_id").count().agg({"count": "max"}).first()[0] == 36 * 20 // 100 + 1


def test_spans_are_the_starts_with_enough_anchors(spark):
    rng = random.Random(8)
    hits, wanted = [], set()
    for doc_id, size, n in [(1, 900, 9), (2, 700, 300), (3, 8, 10), (4, 1, 1), (5, 5, 9), (6, 2_000, 20)]:
        places = [p for p in range(size) if rng.random() < 0.93]
        hits += [(doc_id, size, n, p, True) for p in places]
        for s in range(max(size - n, 0) + 1):
            if sum(s <= p < s + n for p in places) * 180 >= (n + min(n, size)) * 80:
                wanted.add((doc_id, s))
    rows = spark.createDataFrame(hits, "doc_id bigint, size int, n int, place int, key boolean")
    got = [(r.doc_id, s) for r in D.spans(rows, D.Settings()).collect() for a in r.spans for s in range(a.low, a.high)]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_texts_meet_their_pieces_by_shuffle_at_any_size(spark, monkeypatch):
    """The plan that reads texts again is the same for small tables, so that its disk grows as the input does."""
    plans = {}

    def spied(df, path, reuse=False):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, path, reuse)

    kept = D.written
    monkeypatch.setattr(D, "written", spied)
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "x y " + text), (2, "none of it")], "doc_id bigint, text string")
    found = D.matches(docs, spark.createDataFrame([(7, text)], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7)}
    joins = [line for line in plans["stretches"].splitlines() if "Join Inner" in line and "doc_id" in line]
    assert joins and all("strategy=merge" in line for line in joins)
