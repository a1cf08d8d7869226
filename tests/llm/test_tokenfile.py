import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import tokenfile

LIBRARY = Tokenizer.from_file(public_tokenizers.path(tokenfile.MODEL))


def check(rows, docs):
    want, at = Counter(), 0
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for (i, _), e in zip(texts, LIBRARY.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter(map(tuple, rows)) == want


def test_whole_table(spark, small):
    check(tokenfile.op10_token_file(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet"))


def test_edges(spark, edge, empty):
    folder = tokenfile.write(edge)
    check(tokenfile.read_back(spark, folder).collect(), edge)
    assert tokenfile.read_back(spark, tokenfile.write(empty)).count() == 0
    counts = {r["id"]: r["n"] for r in spark.read.parquet(f"{folder}/ids").where("n > 0").collect()}
    ids = Counter(i for r in tokenfile.read_back(spark, folder, with_ids=True).collect() for i in r["ids"])
    assert counts == ids


def test_codec_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = tokenfile.pack(x)
        assert len(control) == -(-n // 4) and (tokenfile.unpack(control, data, n) == x).all()
    assert tokenfile.ranking([(3, 9), (1, 9), (2, 10)], 5).tolist() == [2, 1, 3, 0, 4]
