import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe, pretoken, tokenfile

PATH = public_tokenizers.path(bpe.MODEL)
LIBRARY = Tokenizer.from_file(PATH)

ODD = [
    "it's 'tis we'll they've I'm you'd 'S ''s 's's x'rey 'lly re've", "a  b   c\n\n d \t e  f　g  ", "  lead", "trail  ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext", "<", "\x1c\x1d \x85x",
    "ñandú ÉÉ ß 漢字かな 12345 ½ ² Ⅷ ٣٤", "😀👍🏽 x", "x" * 500, "ab" * 400 + "!" * 300, " " * 300 + "x", "'", "''", "'s", " 's", "'d'", "é a​ b", "\n", "'ve'll're", "don't'", "\r\n\r\nfoo",
]


def ids(texts):
    return [x.tolist() for x in bpe.encoder(PATH).texts(texts)]


def test_odd_texts_as_the_library():
    got = ids(ODD)
    for t, x in zip(ODD, got, strict=True):
        assert x == LIBRARY.encode(t, add_special_tokens=False).ids, t


def test_stores_of_few_pieces_take_turns(monkeypatch):
    monkeypatch.setattr(pretoken, "STORE", 4)
    for made in (bpe.encoder(PATH), tokenfile.encoder(PATH)):
        enc = pretoken.Encoder(made.special, made.encode_new)
        older = set()
        for t in [*ODD, *ODD[::-1], "a b a b c d e f a b"]:
            (got,) = enc.texts([t])
            assert got.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t
            older.add(frozenset(enc.older))
        assert len(older) > 2


def test_random_texts_as_the_library():
    rng = random.Random(5)
    alphabet = "aest  '\n\t.,1ré漢<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    for t, x, y in zip(texts, ids(texts), LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert x == y.ids, t


def test_long_and_short_pieces_agree():
    v, pair = pretoken.vocabulary(PATH), bpe._pairs(PATH)
    rng = random.Random(1)
    for _ in range(200):
        word = bytes(rng.choice(b"theation s") for _ in range(rng.randint(2, 60)))
        assert bpe._long(v, word, pair) == bpe._rows(v, [word], 64)[0]


def check(rows, docs):
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = Counter()
    for (i, t), e in zip(texts, LIBRARY.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        decoded = LIBRARY.decode(e.ids, skip_special_tokens=False)
        want[i, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want


def test_whole_table(spark, small):
    check(bpe.op5_bpe(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet"))


def test_edges(spark, edge, empty):
    check(bpe.round_trip(edge).collect(), edge)
    assert bpe.round_trip(empty).count() == 0
    decoded = Counter((r["doc_id"], r["decoded"]) for r in bpe.round_trip(edge, with_ids=True).collect())
    assert decoded == Counter((r["doc_id"], r["text"] or "") for r in edge.collect())
