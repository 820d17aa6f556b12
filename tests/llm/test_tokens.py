import zlib
from array import array
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from spanveil.llm.packing import fullest, pack, padding, plan
from spanveil.llm.pieces import WordIds, pre_tokens
from spanveil.llm.queries import tokenizer
from spanveil.llm.token_counts import count_tokens

TEXTS = [
    (0, None), (1, ""), (2, " \t\n"), (3, "The end."), (4, "The end."), (5, "it's don't we'll ###$$$ a|b"), (6, "<|endoftext|> x<|startoftext|>y <|endof"),
    (7, "Été ÇA ﬁn İstanbul ΣΑΣ é a b　c 日本語 \U0001f600 ½²"), (8, "ab " * 5000), (9, "x" * 30000), (None, "no id"), (11, "ªº µm Ñandú ÿ×÷"), (12, "a\x1cb\x85c\x00d"), (13, "1,000.5 (x) [y] {z} ~^`_\\\"'")]
SCHEMA = "doc_id long, text string, length string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, "clash", 1) for a, b in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    lib = Tokenizer.from_file(tokenizer())
    return [(a, (b or "").encode(), lib.encode(b or "", add_special_tokens=False).ids) for a, b in TEXTS]


def test_counts_are_the_library_s(docs, ids):
    got = sorted(map(tuple, count_tokens(docs, tokenizer()).collect()), key=str)
    assert got == sorted(((a, len(b), len(c), len(c) > 2048) for a, b, c in ids), key=str)


@pytest.mark.parametrize("most", [0, 3, 20])
def test_counts_with_few_pre_tokens_broadcast(docs, ids, most):
    got = sorted(map(tuple, count_tokens(docs, tokenizer(), most=most).collect()), key=str)
    assert got == sorted(((a, len(b), len(c), len(c) > 2048) for a, b, c in ids), key=str)


def test_another_tokenizer_whose_pieces_take_in_spaces(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    assert not pre_tokens(path).by_words and pre_tokens(tokenizer()).by_words
    want = sorted((str(a), len(lib.encode(b or "", add_special_tokens=False).ids)) for a, b in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in count_tokens(docs, path).collect()) == want
    own = sorted((str(a), lib.encode(b or "", add_special_tokens=False).ids) for a, b in TEXTS)
    assert sorted((str(a), [*array("I", WordIds(path).of((b or "").encode()))]) for a, b in TEXTS) == own


def check_packing(rows, ids, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sorted(map(str, pieces)) == sorted(str(a) for a, _, _ in ids)
    for doc, _, own in ids:
        own, at = [*own, 1], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(array("I", own[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_holds_each_id_once(docs, ids, capacity):
    check_packing(pack(docs, tokenizer(), capacity).collect(), ids, capacity)


def test_empty_tables(docs):
    assert pack(docs.limit(0), tokenizer()).collect() == []
    assert count_tokens(docs.limit(0), tokenizer()).collect() == []


def test_fullest_is_the_least_padding():
    import itertools
    import random

    r = random.Random(1)
    for _ in range(200):
        capacity = r.choice([16, 24, 50])
        items = [r.randint(1, capacity - 1) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        chosen = fullest(dict(counts), capacity)
        assert all(counts[x] >= k for x, k in chosen.items()) and max(items) in chosen
        rest = list(items)
        rest.remove(max(items))
        best = min(padding(max(items) + sum(s), capacity) for n in range(len(rest) + 1) for s in itertools.combinations(rest, n) if max(items) + sum(s) <= capacity)
        assert padding(sum(x * k for x, k in chosen.items()), capacity) == best
        used = defaultdict(int)
        for multiset, times in plan(dict(counts), capacity):
            for x, k in multiset.items():
                used[x] += k * times
        assert dict(used) == counts


def test_documents_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = Tokenizer.from_file(tokenizer())
    ids = [(r.doc_id, r.text.encode(), lib.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()]
    rows = pack(docs, tokenizer()).collect()
    check_packing(rows, ids, 2048)
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(padding(n, 2048) for n in used.values()) < 0.05 * sum(used.values())
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, tokenizer()).collect()) == sorted((a, len(c)) for a, _, c in ids)
