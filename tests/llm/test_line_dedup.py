from collections import Counter, defaultdict

import pytest
from compare import connect, differences

from roadledger.llm import checks
from roadledger.llm import line_dedup as L
from roadledger.llm.queries import QUERIES


def brute(rows, ratio, least):
    pages = defaultdict(set)
    for _, host, text in rows:
        if host is not None and text is not None:
            pages[host].add(text)
    bad = {}
    for host, texts in pages.items():
        counts = Counter(line for t in texts for line in {x.strip(" \t\r") for x in t.split("\n")} if line)
        bad[host] = {line for line, n in counts.items() if n >= least and n > len(texts) * ratio}
    out = []
    for doc_id, host, text in rows:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(" \t\r") or x.strip(" \t\r") not in bad.get(host, ())]
        if not any(x.strip(" \t\r") for x in kept):
            kept = lines
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = (
    [(i, "a", f"Home \t\nbody {i}\n\n  Contact\r\nend") for i in range(20)]
    + [(100 + i, "a", "only copies\nof one page") for i in range(50)]
    + [(200 + i, "b", f"Home\nbody {i}") for i in range(3)]
    + [(300 + i, None, "Home\nContact") for i in range(9)]
    + [(400, "a", "Home\nContact"), (401, "a", ""), (402, "a", None), (403, "a", "Home\n" * 30_000 + "x"), (404, None, None)]
    + [(405, "b", "Home\nbody 405"), (405, "b", "Home\nbody 405"), (406, "b", "Home\nb"), (None, "b", "Home\nc\n")]
)


@pytest.mark.parametrize("ratio,least", [(0.1, 5), (0.5, 1), (0.0, 2)])
def test_against_brute_force(spark, ratio, least):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id bigint, source string, text string, lines string")
    found = L.marked(docs, settings=L.Settings(ratio, least))
    got = [(r.doc_id, r.line_dedup_lines, r.line_dedup_dropped, r.line_dedup_text) for r in found.collect()]
    assert sorted(got, key=str) == brute(ROWS, ratio, least)


def test_cleaned_keeps_columns_and_counts_characters(spark):
    docs = spark.createDataFrame([(*r, 99) for r in ROWS], "doc_id bigint, source string, text string, n_chars bigint")
    out = L.cleaned(docs)
    assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == len(ROWS)
    assert out.filter("doc_id = 3").first().n_chars == len("body 3\n")
    assert L.cleaned(docs.limit(0)).count() == 0


def test_clashing_names_are_carried(spark):
    names = ["line_dedup_host", "line_dedup_known", "line_dedup_here", "line_dedup_kept", "line_dedup_text", "host", "known", "row", "of_host", "kept", "a b"]
    docs = spark.createDataFrame([(*r, *(f"{n}-{r[0]}" for n in names)) for r in ROWS], "doc_id bigint, source string, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = L.cleaned(docs)
    assert out.columns == docs.columns
    assert all(r[n] == f"{n}-{r.doc_id}" for r in out.collect() for n in names)
    found = [(r.doc_id, r.line_dedup_lines, r.line_dedup_dropped, r.line_dedup_text) for r in L.marked(docs).collect()]
    assert sorted(found, key=str) == brute(ROWS, 0.1, 5)
    assert L.marked(docs).columns == [c for c in docs.columns if c != "line_dedup_text"] + list(L.OUTPUT)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id bigint, source string, text string, n_chars bigint")
    assert "Python" not in L.cleaned(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_checking_sql(spark, sf_dir):
    found = QUERIES["op10_line_dedup"](spark, sf_dir)
    assert differences(found, connect(sf_dir), checks.statements()["op10_line_dedup"]) == ""
    assert sf_dir.endswith("0.001") or found.filter("n_dropped > 0").count() > 0
