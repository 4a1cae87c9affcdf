import itertools
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from roadledger.llm import packing as P
from roadledger.llm import text as words
from roadledger.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, length):
    """Every id lies in exactly one piece, sequences are gapless, only the last is not full."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, group in by_sequence.items():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or (number == len(by_sequence) - 1 and at <= length)


def test_query_against_the_tokenizer(spark, data_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    check(QUERIES["op9_packing"](spark, data_dir).collect(), docs, 4096)


@pytest.mark.parametrize("length", [1, 7, 64])
def test_odd_texts(spark, length):
    texts = [None, "", " ", "It's 42 <|endoftext|> ok", "é x y z ́b", "A\x1cB \x85 C", "ΑΣ ΣΑΣ", "日本 語😀", "don't " * 500, "x" * 3000]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, key int")
    check(P.pack(frame, P.Settings(PATH, length=length)).collect(), docs, length)


def test_empty_null_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    pieces = P.pack(frame, P.Settings(PATH)).collect()
    assert sorted((p.offset, p.length) for p in pieces) == [(0, 3), (3, 3), (6, 3)]
    assert P.pack(frame.limit(0), P.Settings(PATH)).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_all_cells_in_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = P.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_words(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice([f"topic{i % 8}word{k}" for k in range(30)], 80))) for i in range(160)]
    encoder = P.Encoder(open(PATH).read(), P.Settings(PATH))
    _, keys = encoder([t for _, t in rows])
    topics = np.array([i % 8 for i, _ in rows])[np.argsort(keys, kind="stable")]
    assert (topics[1:] == topics[:-1]).mean() > 0.5


def test_repeated_words_outlive_a_full_cache(monkeypatch):
    """Words met again are not encoded again when the cache is full; those met once are forgotten."""
    monkeypatch.setattr(P, "CACHE_WORDS", 40)
    monkeypatch.setattr(P, "KEPT_WORDS", 8)
    encoder, handed = P.Encoder(open(PATH).read(), P.Settings(PATH)), []
    features = encoder.table.features
    encoder.table.features = lambda new: handed.extend(new) or features(new)
    tokenizer = Tokenizer.from_file(PATH)
    for k in range(12):
        texts = ["Often, seen <|x often again!", f"a{k} " + " ".join(f"Once{k}w{j}." for j in range(20))]
        found, _ = encoder(texts)
        for text, ids in zip(texts, found):
            assert np.frombuffer(ids, encoder.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert encoder.table.filled == len(encoder.table.index) == len(encoder.coded) == len(encoder.uses) <= 40 + 26
    assert handed.count(b"Often,") == 1 and handed.count(b"often") == 1


def test_a_cached_word_takes_little_memory():
    """A full cache holds arrays, not objects for each word and its ids."""
    encoder = P.Encoder(open(PATH).read(), P.Settings(PATH))
    new = [f"w{k}x{k * k} y{k}." for k in range(40_000)]
    tracemalloc.start()
    encoder.encode(pa.array(new, pa.string()))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert encoder.table.filled == 80_000 and held < 130 * 80_000
    encoder.uses[::3] += 2
    encoder.keep_repeated()
    assert encoder.table.filled == len(encoder.table.index) == len(encoder.coded) == len(encoder.uses)
    tokenizer = Tokenizer.from_file(PATH)
    for text, ids in zip(new[::997], encoder(new[::997])[0]):
        assert np.frombuffer(ids, encoder.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_words_of_letters_go_straight_to_the_model():
    """Neither the tokenizer's normalizer nor its patterns are run for them, whatever ends them; the ids are the same."""
    tokenizer = Tokenizer.from_file(PATH)
    encoder, whole = P.Encoder(open(PATH).read(), P.Settings(PATH)), []

    class Watched:
        model = tokenizer.model

        def encode(self, text, **options):
            whole.append(text)
            return tokenizer.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            whole.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched()
    easy = ["The Weather, isöliche. caf\xe9! \xc9T\xc9&&& Stra\xdfe### \xffa\xc0\xf8\xdem", "the\x0bthe\x0c  the\r\n", None, " \t"]
    odd = ["don't dogs' x\xd7y 2\xf7 a\u0301b \xe9\u0301. \u0391\u03a3 42# <|endoftext|>. Is<|startoftext|>! a.b### \x1f. \u212a\u0130", "\x1c\x85 \xd7### \xb5. \xaa\xba"]
    ends = []
    for texts in (easy, odd, easy + odd):
        for text, ids in zip(texts, encoder(texts)[0]):
            assert np.frombuffer(ids, encoder.kind).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        ends.append(" ".join(whole))
    assert not any(c.isalpha() for c in ends[0]) and any(c.isalpha() for c in ends[1])


def test_distinct_words_are_the_words_of_each_text():
    texts = [None, "", "b a\tb", "".join(map(chr, range(64))) * 2, " \n", "  a\x0b\x0c\r\u2003\x85 c\x1cd "]
    for some in ([], texts[:2], ["a b", "b"], texts):
        distinct, place, counts = words.distinct_words(pa.array(some, pa.string()))
        found = [distinct[k] for k in place]
        assert found == [word for text in some for word in words.words_of(text)] and counts.tolist() == [len(words.words_of(t)) for t in some]
        assert distinct == list(dict.fromkeys(found))
