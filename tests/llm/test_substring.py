import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadledger.llm import substring as S
from roadledger.llm import text as W
from roadledger.llm.queries import QUERIES


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


def test_query_against_brute_force(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, data_dir).collect()}
    wanted = {k: (n, g, hashlib.sha256(t.encode()).hexdigest()) for k, (n, g, t) in brute(rows).items()}
    assert got == wanted


@pytest.mark.parametrize("window", [1, 2, 5, 20])
def test_random_and_periodic_texts(spark, window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(15, 60))] for _ in range(8)]
    passages += [["x"] * 70, ["x", "y"] * 40, ["x", "x", "y"] * 30, ["ü"] * 19 + ["z"]]
    rows = []
    for doc_id in range(60):
        text = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            text += p[rng.randrange(4) : len(p) - rng.randrange(6)]
            text += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 4))]
        rows.append((doc_id, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(S.kept_texts(docs, window)) == brute(rows, window)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("aaab"), max_size=90), st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_equal_windows_have_equal_marks(middle, before, after):
    texts = ["".join(f"{x} " for x in part) for part in (middle, before + middle + after, after + middle)]
    flat, counts = (table := W.WordTable(W.hash64)).lookup(texts)
    if not len(flat):
        return
    begin, marks, _ = S.window_marks(table.rows[flat], counts, 20)
    names = table.rows[flat]
    by_window = {}
    for start, mark in zip(begin, marks):
        assert by_window.setdefault(names[start : start + 20].tobytes(), mark) == mark


def test_edges_nulls_repeats_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 1), (None, text, 2), (6, None, 3), (7, "", 4), (8, "a " + text, 5), (9, text + "\nb", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, removed int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in S.kept_texts(docs).collect()), key=str)
    wanted = [(5, 30, 0), (5, 30, 0), (None, 30, 0), (6, 0, 0), (7, 0, 0), (8, 31, 30), (9, 31, 30)]
    assert got == sorted(wanted, key=str)
    assert S.kept_texts(docs.limit(0)).count() == 0


def test_long_text(spark):
    rng = np.random.default_rng(1)
    text = " ".join(f"v{i}" for i in rng.integers(0, 400, 120_000))
    rows = [(1, text), (2, text), (3, "x " * 50_000)]
    assert found(S.kept_texts(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_marks_are_made_once(spark, monkeypatch):
    """Counts and join read the same written marks."""
    plans = {}

    def kept(df, path, write=S.written):
        plans[path.rsplit("/", 1)[-1].rsplit("-", 1)[0]] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, path)

    monkeypatch.setattr(S, "written", kept)
    passage = " ".join(f"p{k}" for k in range(25))
    docs = spark.createDataFrame([(1, passage), (2, f"a {passage} b")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.kept_texts(docs).collect()) == [(1, 0), (2, 25)]
    assert sum(plan.count("MapInArrow") for plan in plans.values()) == 1


def test_slices_of_a_batch_give_what_the_batch_gives():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"é{x}" for x in rng.integers(0, 9, rng.integers(0, 90))) if k % 7 else None for k in range(300)]
    stretches = [[{"first": int(a), "windows": 3} for a in rng.integers(0, 60, 3)] if k % 3 and k % 11 else None for k in range(300)]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("windows", pa.int32())]))
    part = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array(stretches, kind), pa.nulls(300, pa.list_(pa.int64())), pa.array([k % 11 == 0 for k in range(300)])],
        names=["text", "stretches", "firsts", "copy"],
    )
    whole = S._removed(part, 5, W.WordTable(W.hash64)).to_pylist()
    table = W.WordTable(W.hash64)
    cut = [r for some in W.slices(part, "text", 3_000) for r in S._removed(some, 5, table).to_pylist()]
    assert whole == cut
    for k, ranges in enumerate(whole):
        count, gone = len(split(texts[k])), set()
        for s in stretches[k] or []:
            for at in range(s["first"], min(s["first"] + 3, count - 4)):
                gone.update(range(at, at + 5))
        if k % 11 == 0 and count >= 5:
            gone = set(range(count))
        assert {w for r in ranges for w in range(r["start"], r["end"])} == gone
