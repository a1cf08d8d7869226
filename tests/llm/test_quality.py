import re
from collections import Counter

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(rows, texts):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in texts)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_edges(spark, edge, empty):
    check(quality.quality(edge).collect(), [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert quality.quality(empty).count() == 0


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(quality.op1_quality_rules(spark, small).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_bad_host_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "en", "bad", 1) for i in range(200)] + [(200, good, "en", "bad", 1)] + [(300 + i, good + str(i), "en", f"h{i % 9}", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    assert kept == set(range(300, 390))
    assert {r["doc_id"] for r in quality.stage(spark, docs, "").collect()} == kept


def test_prior_is_bounded():
    a, b = quality.beta_prior(10, 100, 1.0, 0.1, 1.0, 10)
    assert a > 0 and b > 0 and quality.STRENGTH[0] <= a + b <= quality.STRENGTH[1] * 1.001
    assert quality.beta_prior(0, 0, 0, 0, 0, 0)


def test_weak_rules_count_where_the_host_is_suspect(spark):
    """Symbols are a fault on a host full of them and none on a host of clean pages; stage and query agree, null ids too."""
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{good} {'# ' * 20 if i % 3 == 0 else ''}{i}", "en", "noisy", 1) for i in range(300)]
    rows += [(1000 + i, f"{good} {'# ' * 20 if i == 7 else ''}{i}", "en", "clean", 1) for i in range(900)]
    rows += [(None, f"{good} # {'# ' * 20}", "en", "noisy", 1), (None, good, "en", "noisy", 1), (None, "short", None, None, None), (5000, f"{good} {'# ' * 20}", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter(r["doc_id"] for r in quality.quality(docs).where("kept").collect())
    assert kept == Counter({i: 1 for i in range(300) if i % 3}) + Counter({1000 + i: 1 for i in range(900)}) + Counter({None: 1, 5000: 1})
    assert Counter(r["doc_id"] for r in quality.stage(spark, docs, "").collect()) == kept
    out = quality.stage(spark, docs.withColumnRenamed("lang", "rule"), "")
    assert out.columns == ["doc_id", "text", "rule", "source", "n_chars"] and out.count() == sum(kept.values())


def test_windows_whose_hashes_meet(spark, monkeypatch):
    """With no or few bits of the hash left, different windows lie between equal ones."""
    import random

    rng = random.Random(4)
    texts = ["a b c x y z a b c", "a b c d a b c", "a a a a b", "p q r s t u v"] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for bits in (0, 7 << 60):
        monkeypatch.setattr(quality, "HASH_BITS", bits)
        check(quality.quality(docs).collect(), list(enumerate(texts)))
