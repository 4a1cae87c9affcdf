"""Secret scan: all rules in one pass of a combined deterministic automaton.

A rule is a kind, a pattern and a least length, of the whole match or of one group. Matches of a
kind lie leftmost, as long as possible and do not overlap; those that are too short are dropped
after that, so what they cover is not searched again. Positions count code points, ends are
exclusive.

Defined results: null and empty texts have no spans; texts of any length are scanned whole;
repeated rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadledger.llm import text as words
from roadledger.llm.automaton import Scanner


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int
    group: int = 0


BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # Shorter runs would be dropped anyway; counting here keeps every a-f letter from accepting.
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner([rule.pattern for rule in rules])


def spans_of(
    texts: list[str | None], rules: tuple[Rule, ...] = RULES, compiled: Scanner | None = None
) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, by start, then in the order of the rules."""
    compiled = compiled or scanner(rules)
    coded = [text.encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    data = np.frombuffer(b"\n".join(coded), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in coded])])
    found: list[list[tuple[int, int, int]]] = [[] for _ in coded]
    matches = compiled.matches(data)
    owners = np.searchsorted(starts, [m[1] for m in matches], side="right") - 1
    for (number, start, end), owner in zip(matches, owners.tolist()):
        rule, begin = rules[number], int(starts[owner])
        start, end = start - begin, end - begin
        if rule.group:
            text = coded[owner][start:end].decode("ascii")
            length = len(re.fullmatch(rule.pattern, text).group(rule.group))
        else:
            length = end - start
        if length >= rule.least:
            found[owner].append((start, number, end))
    out = []
    for raw, spans in zip(coded, found):
        if spans and not raw.isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            spans = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
        out.append([(rules[k].kind, a, b) for a, k, b in sorted(spans)])
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row; spans lie by start, then in the order of the rules."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # a few MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                spans = [
                    [{"kind": kind, "start": start, "end": end} for kind, start, end in found]
                    for found in spans_of(part.column("text").to_pylist(), rules, shared.value)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(spans, _SPAN_TYPE)], names=["doc_id", "spans"]
                )

    return words.texts_of(docs).mapInArrow(run, f"doc_id bigint, spans {SPANS}")
