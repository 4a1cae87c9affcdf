import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadledger.llm import minhash as M
from roadledger.llm.components import roots
from roadledger.llm.queries import QUERIES


def brute_sets(texts, size):
    out = []
    for text in texts:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def brute(rows, size, percent=80):
    sets = brute_sets([t for _, t in rows], size)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return {(doc_id, len(sets[i]), min(groups[find(i)])) for i, (doc_id, _) in enumerate(rows)}


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in rows}


def test_query_against_brute_force(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    assert found(QUERIES["op3_minhash_dedup"](spark, data_dir)) == brute(rows, 2)


def varied(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_chains_and_crowded_buckets_lose_no_link(spark, size):
    """Copies at many distances around shared centres, so that stars alone would miss links."""
    rng = random.Random(size)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for changes in (0, 1, 2, 3, 4, 6, 8):
            texts += [varied(rng, base, changes) for _ in range(6)]
    texts += ["A b  C", "a B c", "a b\tc d", "x", "X", "", None, " \n", "a b c d e f g h", "a b c d e f g h i"]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(M.components(docs, M.Settings(shingle=size))) == brute(rows, size)


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    hits = []
    for n in (4, 40, 400):
        for _ in range(60):
            common = rng.integers(0, 2**64, n, np.uint64)
            left = np.unique(np.concatenate([common, rng.integers(0, 2**64, n // 4, np.uint64)]))
            sign = M.signatures([np.unique(common), left], 240)
            hits.append((sign[0] == sign[1]).mean() - len(common) / len(left))
    assert abs(np.mean(hits)) < 0.02


def test_roots_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(500, i) for i in range(501, 600)] + [(700, 699), (699, 700)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    wanted = {i: 1 for i in range(2, 201)} | {i: 500 for i in range(501, 600)} | {700: 699}
    assert got == wanted


def test_edges_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (2, None, 6), (3, "", 7), (None, "a b c d e f", 8), (4, "A b c d e f", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, root bigint")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.components(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 1, False)], key=str)
    kept = sorted(((r.doc_id, r.root) for r in M.deduplicated(docs).collect()), key=str)
    assert kept == sorted([(1, 5), (2, 6), (3, 7), (None, 8)], key=str)
    assert M.components(docs.limit(0)).count() == 0


def test_members_of_finished_buckets_are_not_carried_on(spark, monkeypatch):
    """Small buckets end in one round; members of crowded ones get their root by one join a round."""
    rng = random.Random(4)
    texts = []
    for _ in range(10):
        base = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        texts += [varied(rng, base, changes) for changes in (0, 1, 2, 3)]
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts += [varied(rng, base, 8) for _ in range(60)]
    tables, opened = [], []

    def kept(df, path, write=M.written):
        tables.append((path.rsplit("/", 1)[-1], df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, path)

    def taken(members, do=M._open_members):
        opened.append((members.count(), members.select("node").distinct().count()))
        if len(opened) != 2:  # that one leaves out who needs no star
            assert "Join" not in members._jdf.queryExecution().optimizedPlan().toString()
        return do(members)

    monkeypatch.setattr(M, "written", kept)
    monkeypatch.setattr(M, "_open_members", taken)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(M.components(docs, M.Settings(shingle=2))) == brute(rows, 2)
    assert opened[0][0] > 0 and opened[0][1] <= 60
    assert not [name for name, plan in tables if not name.startswith("pairs") and "LeftAnti" in plan]


def test_pairs_that_share_rare_shingles_take_no_round_of_their_own(spark, monkeypatch):
    """They are confirmed along with the stars of the second round, and the components found once for both."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [varied(rng, base, 8) for _ in range(100)]
    other = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts += [varied(rng, other, changes) for changes in (0, 12, 14, 16, 18)]
    tables = []

    def kept(df, path, write=M.written):
        tables.append(path.rsplit("/", 1)[-1])
        return write(df, path)

    monkeypatch.setattr(M, "written", kept)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(M.components(docs, M.Settings(shingle=2))) == brute(rows, 2)
    assert "rare" in tables and "members-3" in tables
    assert tables[-1].startswith("members-")


@pytest.mark.parametrize("held", [33, 60, 1000])
def test_every_member_is_a_centre_in_some_round(spark, held):
    members = spark.range(held).selectExpr("id node", "7L bucket", f"{held}L held", "0L first").cache()
    one = members.filter(M._central(1)).collect()
    assert [r.node for r in one] == [0]
    assert 4 <= members.filter(M._central(16)).count() <= 40
    assert members.filter(M._central(16**3)).count() == held
    assert members.withColumn("held", F.lit(M.SMALL)).filter(M._central(1)).count() == held
