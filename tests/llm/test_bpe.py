import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.common import table

LIBRARY = Tokenizer.from_file(bpe.default_tokenizer())


def whole(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False)


def random_texts(seed, n):
    random.seed(seed)
    alphabet = ["a", "B", "é", "é", "'s", "'", "İ", "Σ", "日本", "12", "½", " ", " ", "\n", "\t\r", "\x0b", "\x1c", "\x85", "　", "<|endoftext|>", "<|", "-!", "\U0001f600", "ſ", "th", "ing ", "́"]
    return ["".join(random.choices(alphabet, k=random.choice([0, 1, 5, 40, 400]))) for _ in range(n)]


def test_texts_of_all_kinds_match_the_library():
    texts = random_texts(1, 400) + ["x" * 5000, "é" * 3000, " " * 3000, "word " * 3000]
    encoder = bpe.Encoder(bpe.default_tokenizer())
    for low in range(0, len(texts), 50):
        part = texts[low : low + 50]
        assert encoder.encode([t.encode() for t in part]) == [whole(t) for t in part]


def test_small_stores_give_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 5)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 20)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 16)
    encoder = bpe.Encoder(bpe.default_tokenizer())
    for t in random_texts(2, 60):
        assert encoder.encode([t.encode()] * 2) == [whole(t)] * 2


def test_documents_match_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs).collect()}
    for r in docs.collect():
        ids, text = whole(r.text)
        assert got[r.doc_id] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("packed", [True, False])
def test_edge_rows(spark, packed):
    rows = [(1, None), (1, ""), (None, "Hi there"), (2, "Hi there"), (2, "Hi there"), (3, "a" * 300_000)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    got = sorted(((r.doc_id, bytes(r.ids) if packed else np.array(r.ids, dtype="<u4").tobytes(), r.decoded) for r in bpe.encode(df, packed=packed).collect()), key=str)
    assert got == sorted(((d, *whole(t)) for d, t in rows), key=str)
    assert bpe.encode(df.limit(0), packed=packed).collect() == []


def test_most_repeated_bytes_are_reused(spark):
    """Chunks that any earlier chunk of 10,000 documents repeats, as a share of all bytes, and what the kept ones carry of it."""
    texts = [(r.text or "").encode() for r in table(spark, "/root/testdata/sf0.1", "documents").select("text").collect()]
    encoder, seen, repeated = bpe.Encoder(bpe.default_tokenizer()), set(), 0
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        encoder.encode(part)
        for t in part:
            bounds = [0, *bpe.cuts(np.frombuffer(t, dtype=np.uint8), bpe.CHUNK_BYTES).tolist(), len(t)]
            for a, b in zip(bounds, bounds[1:]):
                repeated += (b - a) * (t[a:b] in seen)
                seen.add(t[a:b])
    print("of", encoder.bytes, "bytes repeat", repeated / encoder.bytes, "reused", encoder.reused / encoder.bytes)
    assert encoder.bytes == sum(map(len, texts)) and repeated > 0
    assert 0.8 * repeated < encoder.reused <= repeated * 1.01


def test_copies_are_encoded_once():
    text = " ".join(random_texts(3, 200)).encode()
    encoder = bpe.Encoder(bpe.default_tokenizer())
    assert len(text) > 20_000
    (want,) = encoder.encode([text])
    before = encoder.reused
    moved = b"a shifted start " + text
    assert encoder.encode([text, moved])[0] == want
    assert encoder.reused - before > 1.9 * len(text)


def test_words_of_a_task_are_learned_once():
    """Words that come back after 60,000 others are still kept; with a smaller store they are learned again, to the same ids."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(60_000)]
    texts = [" ".join(words[i : i + 5000]).encode() for i in range(0, 60_000, 5000)] + [" ".join(words[:5000][::-1]).encode()]
    got = []
    for kept in (None, 10_000):
        encoder, learned = bpe.Encoder(bpe.default_tokenizer()), []
        encoder.kept_pieces = kept or encoder.kept_pieces
        real = encoder._learn
        encoder._learn = lambda pieces, real=real, learned=learned: (learned.append(len(pieces)), real(pieces))
        got.append([encoder.encode([t]) for t in texts])
        assert (sum(learned) == 60_000) == (kept is None)
    assert got[0] == got[1]
