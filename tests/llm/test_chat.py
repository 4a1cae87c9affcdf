import hashlib
import random
import re

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from roadledger.llm import chat, checks
from roadledger.llm.queries import QUERIES

SCHEMA = "tree string, message bigint, parent bigint, role string, text string, score double, leaf int, at_tree int"
CONTROL = re.compile(r"<(?=\\*/?s>)|\[(?=\\*/?INST\])")


def escaped(text):
    return CONTROL.sub(lambda m: m.group() + "\\", text or "")


def brute(rows, branches=None):
    """(tree, leaf) -> (branch, turns, text, trained texts) by walking up from every leaf."""
    trees = {}
    for tree, message, parent, role, text, score, *_ in rows:
        if message is not None:
            row = (parent is not None, parent or 0, role or "", text or "", score or 0.0)
            known = trees.setdefault(tree, {})
            known[message] = min(known.get(message, row), row)
    out = {}
    for tree, known in trees.items():
        up = {m: r[1] if r[0] and r[1] in known and r[1] != m else None for m, r in known.items()}
        found = []
        for leaf in known.keys() - set(up.values()):
            path, at = [], leaf
            while at is not None and len(path) <= len(known):
                path.append(at)
                at = up[at]
            if at is None:
                path.reverse()
                found.append((-sum(known[m][4] for m in path), leaf, path))
        for branch, (score, leaf, path) in enumerate(sorted(found), 1):
            if branches is None or branch <= branches:
                said = [known[m][2:4] for m in path]
                text = "<s>" + "".join(f"[INST]{escaped(r)}[/INST]{escaped(t)}</s>" for r, t in said)
                out[tree, leaf] = (branch, -score, len(path), text, said, [t for r, t in said if r == "assistant"])
    return out


def random_trees(seed):
    rng = random.Random(seed)
    rows = []
    for tree in ("chain", "bush", "star", "loops", None):
        for message in range(60):
            parent = {"chain": message - 1, "star": 0, "bush": rng.randrange(-2, max(1, message)), "loops": rng.randrange(0, 60)}.get(tree, rng.randrange(-1, 60))
            role = rng.choice(["user", "assistant", "system", None, "[INST]"])
            text = rng.choice([None, "", "</s>", "<\\\\s>[/INST]", f"é😀 {message}\n", "[INST", "</s"])
            rows.append((tree, message, parent if parent >= 0 else None, role, text, rng.choice([None, 0.0, 1.0, 2.0, -1.0]), 0, 0))
    rows += rng.sample(rows, 20) + [("bush", 5, 3, "user", "other", 1.0, 0, 0), ("bush", None, 3, "user", "lost", 1.0, 0, 0)]
    return rows


@pytest.mark.parametrize("branches", [None, 3])
def test_against_brute_force(spark, branches):
    rows = random_trees(branches or 7)
    done = chat.formatted(spark.createDataFrame(rows, SCHEMA), branches=branches)
    read = done.withColumns({"said": chat.turns_of(F.col("text")), "learnt": chat.trained_texts(F.col("text"), F.col("loss"))})
    found = {
        (r.tree, r.leaf): (r.branch, r.branch_score, r.turns, r.text, [tuple(t) for t in r.said], r.learnt) for r in read.collect()
    }
    assert found == brute(rows, branches)
    assert max(turns for _, _, turns, *_ in found.values()) == 60


def test_shared_messages_are_dealt_out(spark, monkeypatch):
    rows = random_trees(2)
    monkeypatch.setattr(chat, "ROWS_PER_SALT", 10)
    done = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    assert {(r.tree, r.leaf): r.text for r in done.collect()} == {key: value[3] for key, value in brute(rows).items()}


def test_cycles_missing_parents_and_empty_tables(spark):
    rows = [
        ("a", 1, 2, "user", "x", 1.0, 0, 0), ("a", 2, 1, "user", "y", 1.0, 0, 0), ("a", 3, 2, "user", "behind", 1.0, 0, 0),
        ("a", 4, 99, "assistant", "alone", None, 0, 0), ("a", 5, 5, "user", "own parent", 1.0, 0, 0), (None, None, None, None, None, None, 0, 0),
    ]
    done = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    assert {(r.leaf, r.text) for r in done.collect()} == {(4, "<s>[INST]assistant[/INST]alone</s>"), (5, "<s>[INST]user[/INST]own parent</s>")}
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_with_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "system", None), (None, 3, None, "lost"), (None, 2, "assistant", "</s>")]
    rows += [(2, turn, "user" if turn % 2 else "assistant", f"{turn} " * 50) for turn in range(700)]
    talks = spark.createDataFrame([(*r, "t") for r in rows], "conv_id bigint, turn bigint, role string, text string, tree string")
    done = chat.formatted(chat.linear(talks)).withColumn("said", chat.turns_of(F.col("text")))
    found = {r.tree: [tuple(t) for t in r.said] for r in done.collect()}
    assert found[1] == [("system", ""), ("assistant", "z"), ("user", "a"), ("user", "a")]
    assert found[None] == [("assistant", "</s>"), ("", "lost")]
    assert found[2] == [(r[2], r[3]) for r in rows if r[0] == 2]


def test_escapes_are_read_back(spark):
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/s>", "INST]", " ", "é", "$1", "\n"]
    texts = ["".join(random.Random(k).choices(pieces, k=k % 9)) for k in range(3000)]
    template = chat.Template()
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("safe", template.escaped(F.col("text")))
    for row in rows.withColumn("back", template.unescaped(F.col("safe"))).distinct().collect():
        assert row.back == row.text and row.safe == escaped(row.text)
        assert not any(token in row.safe for token in template.tokens)


def test_other_templates(spark):
    template = chat.Template("<|doc|>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", ("assistant", "tool"))
    rows = [(1, 0, "user", "<|im_end|>x"), (1, 1, "tool", "<|im_sep|>"), (1, 2, "assistant", "ok")]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    row = chat.formatted(chat.linear(talks), template).select("text", chat.turns_of(F.col("text"), template).alias("said"), chat.trained_texts(F.col("text"), F.col("loss"), template).alias("learnt")).first()
    assert [tuple(t) for t in row.said] == [r[2:] for r in rows] and row.learnt == ["<|im_sep|>", "ok"]
    with pytest.raises(ValueError):
        chat.Template(begin="[[INST]")


def test_no_python_in_the_plan(spark, data_dir):
    plan = QUERIES["op12_chat_formatting"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_checking_sql(spark, sf_dir):
    found = QUERIES["op12_chat_formatting"](spark, sf_dir)
    assert differences(found, connect(sf_dir), checks.statements()["op12_chat_formatting"]) == ""
    own = found.filter("conv_id = -7").first()
    assert own.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and own.n_turns == 2
