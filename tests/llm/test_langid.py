import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import langid as L


def slow_counts(text):
    """One place after the other, over the whole text."""
    low = [c.lower()[0] if c.isalpha() else " " for c in f" {text} "]
    n = [np.array([ord(c)], dtype=np.uint32) for c in low]
    zero, out = np.zeros(1, dtype=np.uint32), Counter()
    for k in range(1, len(low) - 1):
        if low[k] != " ":
            out[int(L.gram(zero, n[k], zero, 1)[0])] += 1
            out[int(L.gram(n[k - 1], n[k], zero, 2)[0])] += 1
            out[int(L.gram(n[k - 1], n[k], n[k + 1], 3)[0])] += 1
            if low[k + 1] == " ":
                out[int(L.gram(zero, n[k], n[k + 1], 2)[0])] += 1
    return out


TEXTS = ["", "a", "Ab cD", "  12 3", "straße İé x", "ab" * 40 + " " + "ba" * 30, "😀é", "\x00ü\n"]


def test_counts_across_pieces(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 7)
    monkeypatch.setattr(L, "BATCH_CODES", 20)
    got = L.counts(TEXTS)
    for row, text in zip(got, TEXTS):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == dict(slow_counts(text))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_and_brute_force(spark, docs):
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None]
    some = [slow_counts(r["text"]) for r in train[:40]]
    model = L.fit(docs)
    # document frequencies over all training documents
    n = Counter(k for r in train for k in np.flatnonzero(L.counts([r["text"]])[0]))
    assert model.idf == pytest.approx([math.log((1 + len(train)) / (1 + n[k])) + 1 for k in range(L.DIMS)], rel=1e-5)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    assert len(got) == len(rows)
    for r, c in zip(train, some):  # cosines one by one
        v = {k: math.log1p(x) * model.idf[k] for k, x in c.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cosines = [sum(x * centre[k] for k, x in v.items()) / size for centre in model.centres]
        assert got[r["doc_id"]]["score"] == pytest.approx(max(0.0, min(1.0, max(cosines))), abs=1e-5)
        assert got[r["doc_id"]]["lang_pred"] == (model.langs[int(np.argmax(cosines))] if v else "und")
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held if r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and {r["lang_pred"] for r in got.values()} <= {r["lang"] for r in train} | {"und"}


def test_labels_of_held_out_documents_do_not_matter(spark, docs):
    from pyspark.sql import functions as F

    other = docs.withColumns({"lang": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "xx").otherwise(F.col("lang")), "source": F.lit("s")})
    a, b = L.fit(docs), L.fit(other)
    assert a.langs == b.langs and np.array_equal(a.centres, b.centres) and np.array_equal(a.idf, b.idf)


def test_several_centroids_and_rejection(spark):
    rows = [(k, ("der die und " * 5 + f"wort{'abc'[k % 3]} ") if k % 2 else "the of and " * 5, "de" if k % 2 else "en") for k in range(40)]
    rows += [(100 + k, "ΑΒΓ ΔΕΖ ηθι " * 4, "de") for k in range(20)]  # one language in two scripts
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.langs.count("de") >= 2
    new = spark.createDataFrame([(1, "the and of the"), (2, "und der die"), (3, "αβγ δεζ"), (4, "жжж щщщ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.identify(new, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["en", "de", "de"] and not got[4]["accepted"] and got[4]["lang_pred"] in ("de", "en")


def test_edges(spark, edge, empty):
    model = L.fit(edge)
    got = L.identify(edge, model).collect()
    assert len(got) == edge.count()
    byid = {r["doc_id"]: r for r in got}
    assert (byid[1]["lang_pred"], byid[2]["lang_pred"], byid[7]["lang_pred"]) == ("und",) * 3 and byid[7]["score"] == 0
    assert byid[5]["lang_pred"] != "und" and not byid[None]["held_out"]
    assert L.identify(empty, L.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in L.identify(edge, L.fit(empty)).collect()} == {"und"}
