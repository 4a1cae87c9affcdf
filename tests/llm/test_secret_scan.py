import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadledger.llm import secret_scan as S
from roadledger.llm.queries import QUERIES

REAL = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (r"[0-9a-f]+", 32, 0),
}
ORDER = [rule.kind for rule in S.RULES]


def brute(text):
    out = []
    for rule in S.RULES:
        pattern, least, group = REAL.get(rule.kind, (rule.pattern, rule.least, rule.group))
        for m in re.finditer(pattern, text or ""):
            if len(m.group(group)) >= least:
                out.append((m.start(), ORDER.index(rule.kind), m.end()))
    return [(ORDER[k], a, b) for a, k, b in sorted(out)]


PIECES = st.sampled_from(
    ["token", "Token", "api_key", "APIKEY", "secret", "passwd", "password", "=", ":", " ", "  ", '"', "'", "\n", "é", "😀"]
    + ["AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeefdeadbeefdeadbeefdeadbeef", "abc", "x", ".", "-", "_", ","]
    + ["ghp_", "a" * 36, "eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "F" * 40]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=40))
def test_spans_equal_those_of_the_regex_module(texts):
    assert S.spans_of(texts) == [brute(text) for text in texts]


def test_consumed_text_is_not_searched_again():
    text = "token=token: abcdefgh12 token=secret=abcdefgh"
    assert S.spans_of([text]) == [brute(text)]
    assert S.spans_of([None, "", "token=abc"]) == [[], [], []]


def test_long_single_stretch():
    text = "x" * 300_000 + " password=" + "Ab1" * 50_000 + " " + "0f" * 40_000
    assert S.spans_of([text, "secret: hunter2hunter2"]) == [brute(text), brute("secret: hunter2hunter2")]


def test_automaton_is_small_and_lines_are_independent():
    scanner = S.scanner(S.RULES)
    assert len(scanner.forward.table) < 20_000
    assert scanner.reset[ord("\n")] and not scanner.reset[ord(" ")]


def test_query_against_brute_force(spark, data_dir, tmp_path):
    own = [(i, f"é{i} Token: {'k' * (i % 12)}{i} AKIA{'Q7' * (i % 9)} {'0f' * (i % 20)}\n{'ab' * 16}") for i in range(10**6, 10**6 + 60)]
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    docs.union(spark.createDataFrame(own, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op2_secret_scan"](spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert sum(r.n_assign for r in rows.values()) and sum(r.n_access for r in rows.values())
    assert len(rows) == len(docs)
    for doc in docs:
        spans = brute(doc.text)
        base = [s for s in spans if s[0] in REAL]
        row = rows[doc.doc_id]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == k for s in base) for k in REAL]
        assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "token=12345678", None)]])
def test_nulls_repeats_and_extra_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    found = sorted(S.scan(docs).collect(), key=str)
    assert len(found) == len(rows)
    if rows:
        assert {(r.doc_id, len(r.spans)) for r in found} == {(1, 0), (2, 0), (None, 1)}
