import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, differences

from roadledger.llm import checks, lexical
from roadledger.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(docs, items, best=20):
    bags = [(key, Counter(cut(text))) for key, text in docs]
    documents, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(term for _, b in bags for term in b)
    asked = {}
    for key, text in set(items):
        if key is not None:
            asked.setdefault(key, Counter()).update(cut(text))
    out = []
    for item, terms in asked.items():
        found = []
        for key, bag in bags:
            n, score = sum(bag.values()), 0
            for term, times in terms.items():
                if bag[term]:
                    m = 75 + (25 * n * documents) // total
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[term] + 1)))
                    score += times * w * ((10**9 * bag[term]) // (1000 * bag[term] + 12 * m))
            if score > 0 and key is not None:
                found.append((-score, key))
        out += [(item, rank, key, -score) for rank, (score, key) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def corpus(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "straße", "İ", "x1", "日本"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 15))) for _ in range(count // 3)]
    return [(k, rng.choice(texts).upper() if k % 7 == 0 else rng.choice(texts) + "." * (k % 3)) for k in range(count)]


def found(spark, docs, items, **options):
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, terms string")
    items = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int")
    rows = lexical.search(docs, items, lexical.Settings(**options)).collect()
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in rows)


ITEMS = [(k, f"w{k} W{k + 1}, w{k}; w{2 * k}\tunseen É\u00a0x1") for k in range(25)]


@pytest.mark.parametrize("best,block_terms", [(20, 500_000), (3, 10), (1, 500_000)])
def test_against_brute_force(spark, best, block_terms):
    docs = corpus(1, 400)
    assert found(spark, docs, ITEMS, best=best, block_terms=block_terms) == brute(docs, ITEMS, best)


def test_copies_share_a_class_and_are_all_ranked(spark):
    docs = [(k, "w1 w2 w3") for k in range(500, 0, -1)] + [(-k, "w1 w2 w3 other" if k % 2 else "w1 other w2 w3!") for k in range(1, 60)]
    items = [(1, "w1"), (2, "other w9")]
    assert found(spark, docs, items) == brute(docs, items)


def test_nulls_empty_and_repeated_rows(spark):
    docs = [(None, "w1 w1"), (3, None), (4, ""), (5, "w1"), (5, "w1"), (5, "w1 w2"), (6, "w2, w2"), (7, "...")]
    items = [(1, "w1 w2"), (1, "w1 w2"), (1, "w2"), (None, "w1"), (2, None), (3, ""), (4, "absent"), (5, "W1")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_very_long_texts_are_read_in_stretches(spark):
    text = "w1 " * 700_000 + "w2,É" * 300_000
    assert Counter(t for part in lexical.terms_of(text, 1000) for t in part) == Counter(x.encode() for x in cut(text))
    docs = [(1, text), (2, "w1 w2"), (3, "É" * 100)]
    assert found(spark, docs, ITEMS[:3]) == brute(docs, ITEMS[:3])


def test_candidates_are_pruned_without_loss(monkeypatch):
    rng, best = random.Random(3), lexical._Best(1, 4)
    rows = [(rng.randrange(0, 9), key) for key in range(300)]
    rng.shuffle(rows)
    monkeypatch.setattr(lexical, "HELD", 12)
    for begin in range(0, len(rows), 7):
        part = rows[begin : begin + 7]
        best.add(np.array([[score] for score, _ in part], np.int64), [[key] for _, key in part])
    _, score, first, number = best.prune()
    assert list(zip(score, first)) == sorted(rows, key=lambda r: (-r[0], r[1]))[:4]
    assert [best.members[n] for n in number] == [[k] for k in first]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_checking_sql(spark, sf_dir):
    result = QUERIES["op13_lexical_search"](spark, sf_dir)
    assert differences(result, connect(sf_dir), checks.statements()["op13_lexical_search"]) == ""
