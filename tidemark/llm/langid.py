"""Language identification by the nearest of several centroids a language.

A text's vector holds the weights of its letter n-grams of one to three places (words padded by a space, everything
that is no letter being a space), hashed to DIMS dimensions: ln(1 + count) times the inverse document frequency, of
length 1. Document frequencies are counted over all training documents. Each language's centroids come from spherical
k-means over at most SAMPLE of its distinct training texts, those of the least hashes; a text gets the language of the
centroid with the largest cosine. A text farther (1 - cosine) from its centroid than REACH times the farthest QUANTILE
of the centroid's own texts is rejected: lang_pred stays the nearest language, `accepted` is false.

What the driver holds and sends: DIMS document frequencies, and CLUSTERS x DIMS floats a learned language.

Defined results: a null text, or one without letters, is `und` with score 0, as are all where nothing was learned; a
null doc_id is not held out and not learned from; texts of any length are read whole, in pieces of PIECE code points;
equal texts have equal results; a language of few texts has fewer centroids; ties go to the language that sorts first;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

BITS = 12
DIMS = 1 << BITS
CLUSTERS, SAMPLE, ROUNDS = 4, 1000, 12
QUANTILE, REACH = 0.99, 1.1
#: Code points of a piece; texts and code points of a batch.
PIECE, BATCH_TEXTS, BATCH_CODES = 1 << 18, 256, 1 << 19
UNKNOWN = "und"


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            out[k] = ord(c.lower()[0])
    return out


def gram(before: np.ndarray, at: np.ndarray, after: np.ndarray, order: int) -> np.ndarray:
    """The dimension of an n-gram; places beyond its order are 0."""
    h = (before * np.uint32(0x9E3779B1)) ^ (at * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D)) ^ np.uint32(order * 0x27D4EB2F)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h >> np.uint32(32 - BITS)


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of (text number, padded piece): each place of a text is inside one piece, with its neighbours."""
    rows, parts, held = [], [], 0
    for k, t in enumerate(texts):
        padded = f" {t} "
        for a in range(0, max(1, len(t)), PIECE):
            part = padded[a : a + PIECE + 2]
            if parts and held + len(part) > BATCH_CODES:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(k)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, parts


def counts(texts: list[str]) -> np.ndarray:
    """How often each text has each n-gram; one row a text."""
    out, zero, space = np.zeros((len(texts), DIMS), dtype=np.int64), np.uint32(0), np.uint32(32)
    for rows, parts in pieces(texts):
        codes = alphabet()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        sizes = np.array([len(p) for p in parts])
        text = np.repeat(np.array(rows), sizes)
        inner = codes != space
        ends = np.cumsum(sizes)
        inner[ends - 1] = inner[ends - sizes] = False  # context only
        at = np.flatnonzero(inner)
        x, y, z, t = codes[at - 1], codes[at], codes[at + 1], text[at].astype(np.int64) << BITS
        last = z == space
        found = [t | gram(zero, y, zero, 1), t | gram(x, y, zero, 2), t[last] | gram(zero, y[last], z[last], 2), t | gram(x, y, z, 3)]
        low, high = rows[0], rows[-1] + 1
        for f in found:
            out[low:high] += np.bincount(f - (low << BITS), minlength=(high - low) << BITS).reshape(-1, DIMS)
    return out


def batched(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_CODES code points, at most BATCH_TEXTS of them."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and (k - start >= BATCH_TEXTS or held + len(t) > BATCH_CODES):
            yield start, k
            start, held = k, 0
        held += len(t)
    if texts:
        yield start, len(texts)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """The texts' TF-IDF vectors of length 1; 0 for a text without letters."""
    out = np.empty((len(texts), DIMS), dtype=np.float32)
    for a, b in batched(texts):
        out[a:b] = np.log1p(counts(texts[a:b])) * idf
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def training(df: DataFrame) -> DataFrame:
    """text, lang of the documents to learn from."""
    return df.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def inverse_frequencies(train: DataFrame) -> np.ndarray:
    """ln((1 + n) / (1 + documents with the n-gram)) + 1 for each dimension, over all training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in batched(texts):
                total[:DIMS] += (counts(texts[a:b]) > 0).sum(axis=0)
            total[DIMS] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], names=["gram", "n"])

    n = np.zeros(DIMS + 1)
    for r in train.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        n[r["gram"]] = r["n"]
    return (np.log((1 + n[DIMS]) / (1 + n[:DIMS])) + 1).astype(np.float32)


def sampled(train: DataFrame) -> DataFrame:
    """lang, h, text: of each language the SAMPLE distinct texts of least hash. Only hashes are ranked; copies of a text
    are one before they are shuffled."""
    hashed = train.withColumn("h", F.xxhash64("text"))
    w = Window.partitionBy("lang").orderBy("h")
    last = hashed.select("lang", "h").distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= SAMPLE).groupBy("lang").agg(F.max("h").alias("last"))
    # one row a language; written, so that its size is known and texts are not sent to languages
    last = common.written(last, "cuts")
    return hashed.join(last, "lang").where("h <= last").groupBy("lang", "h").agg(F.min("text").alias("text"))


def k_means(x: np.ndarray, k: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cosine of each row with its own) of unit rows; each new seed is the row farthest from those before."""
    seeds = [x.sum(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        near = np.max([x @ s / max(float(np.sqrt(s @ s)), 1e-30) for s in seeds], axis=0)
        seeds.append(x[int(near.argmin())])
    centres = np.stack(seeds)
    for _ in range(ROUNDS):
        centres /= np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-30)
        home = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[home == c].sum(axis=0) if (home == c).any() else centres[c] for c in range(len(centres))])
    centres /= np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-30)
    near = x @ centres.T
    used = np.unique(near.argmax(axis=1))
    return centres[used], near[:, used]


class Model:
    """langs[k] and reach[k] belong to row k of centres."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, reach: np.ndarray) -> None:
        self.idf, self.langs, self.centres, self.reach = idf, langs, centres, reach

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, or -1 where there is none; cosine) for each text."""
        x = vectors(texts, self.idf)
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        near = x @ self.centres.T
        at = near.argmax(axis=1)
        some = x.any(axis=1)
        return np.where(some, at, -1), np.where(some, np.clip(near[np.arange(len(at)), at].astype(np.float64), 0, 1), 0.0)


def fit(df: DataFrame) -> Model:
    """Learns from text and lang alone."""
    train = training(df)
    idf = inverse_frequencies(train)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        x = vectors(pdf["text"].tolist(), idf)
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "cluster": [], "centre": [], "reach": []})
        centres, near = k_means(x)
        home, far = near.argmax(axis=1), 1 - near.max(axis=1)
        reach = [float(np.quantile(far[home == c], QUANTILE)) * REACH for c in range(len(centres))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": range(len(centres)), "centre": list(centres.astype(np.float64)), "reach": reach})

    found = sampled(train).groupBy("lang").applyInPandas(cluster, "lang string, cluster int, centre array<double>, reach double").collect()  # CLUSTERS rows a language
    found.sort(key=lambda r: (r["lang"], r["cluster"]))
    centres = np.array([r["centre"] for r in found], dtype=np.float32).reshape(-1, DIMS)
    return Model(idf, [r["lang"] for r in found], centres, np.array([r["reach"] for r in found]))


RESULT = "held_out boolean, lang_pred string, score double, accepted boolean"


def identify(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine with the nearest centroid), accepted."""
    schema = StructType([df.schema["doc_id"], *StructType.fromDDL(RESULT).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            at, score = np.empty(len(texts), dtype=np.int64), np.empty(len(texts))
            for a, b in batched(texts):
                at[a:b], score[a:b] = model.nearest(texts[a:b])
            langs = [UNKNOWN if k < 0 else model.langs[k] for k in at]
            taken = [k >= 0 and 1 - s <= model.reach[k] for k, s in zip(at, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(taken, pa.bool_())], schema=arrow)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return df.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, schema)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op13_language_id": op13_language_id}
ORACLES: dict[str, str] = {}
