"""Quality rules: rules per document, failure rates per host under an empirical beta prior, verdicts joined back.

A document that fails the base rule goes. The other rules (RULES) are weak signs: a page of code may be full of
symbols. They count where the host says so: a host's failures of each rule are added up, its rate is shrunk under a
beta prior fitted to all hosts, and the host is suspect for a rule where its rate exceeds SUSPECT_RATE with
posterior probability of about 0.9 (normal approximation). A document that fails a rule for which its host is suspect
goes. So do all documents of a host whose shrunk rate of base failures exceeds MAX_HOST_RATE.

Defined results: a null or empty text has no words and fails the base rule; a null source has no host verdict;
repeated rows and rows of a null doc_id are separate documents; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50
#: A host is rejected when its shrunk rate of failing documents exceeds this.
MAX_HOST_RATE = 0.8
#: The strength of the prior is held in this range of pseudo documents.
STRENGTH = (2.0, 1000.0)
SYMBOLS = "[#*$%&|<>]"
#: More symbols than this for 100 words, and more repeated lines than this of 100 lines, are failures of weak rules.
SYMBOL_SHARE, LINE_SHARE = 10, 30
RULES = ("base", "symbols", "lines")
#: A host is suspect for a weak rule when its posterior mean less Z standard deviations exceeds this rate.
SUSPECT_RATE, Z = 0.04, 1.2816
SALTS = 16
#: The bits of window hashes that count; all of them, fewer only in tests.
HASH_BITS = -1


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the failures of RULES under a struct named rule.

    Three-word windows are hashed and packed with their position into one long, so that one primitive sort brings
    equal windows together; windows with equal hash bits are compared word by word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": common.words(F.col(text)), "_lines": lines})
    n = F.size("_w")
    out = out.withColumns({
        "_h": F.transform("_w", lambda x: F.xxhash64(x)),
        "_n": F.greatest(n - 2, F.lit(0)),
        "_low": F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + F.lit(2))).cast("int")) - 1,
    })

    def packed(x: Column, i: Column) -> Column:
        window = F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)).bitwiseAND(F.lit(HASH_BITS))
        return window.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long"))

    out = out.withColumn("_packed", F.sort_array(F.transform(F.slice("_h", 1, F.col("_n")), packed)))

    def equal(x: Column, y: Column) -> Column:
        low = F.col("_low")
        p, q = (z.bitwiseAND(low).cast("int") for z in (x, y))
        same = x.bitwiseOR(low) == y.bitwiseOR(low)
        for k in range(3):
            same = same & (F.get("_w", p + k) == F.get("_w", q + k))
        return F.coalesce(same, F.lit(False))

    def repeated(x: Column, i: Column) -> Column:
        low = F.col("_low")
        near = [F.get("_packed", i - 1), F.get("_packed", i + 1)]
        meets = F.coalesce(x.bitwiseOR(low) == near[0].bitwiseOR(low), F.lit(False)) | F.coalesce(x.bitwiseOR(low) == near[1].bitwiseOR(low), F.lit(False))
        # one that shares its bits with neighbours but equals none of them may equal another of the same bits
        return F.when(equal(x, near[0]) | equal(x, near[1]), True).when(meets, F.exists("_packed", lambda y: (y != x) & equal(x, y))).otherwise(False)

    found = F.filter("_packed", repeated)
    out = out.withColumn("_at", found)
    out = out.withColumn("_at", F.sort_array(F.transform("_at", lambda x: x.bitwiseAND(F.col("_low")))))
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", i + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    n_words = n.cast("long")
    rule = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    out = out.withColumn("rule", rule).drop("_w", "_lines", "_h", "_n", "_low", "_packed", "_at")
    failed = (F.col("rule.n_words") < MIN_WORDS) | (100 * F.col("rule.n_repeat_words") > MAX_REPEAT_SHARE * F.col("rule.n_words"))
    symbols = 100 * F.col("rule.n_symbols") > SYMBOL_SHARE * F.col("rule.n_words")
    lines = 100 * F.col("rule.n_dup_lines") > LINE_SHARE * F.col("rule.n_lines")
    return out.withColumn("rule", F.col("rule").withField("base_failed", failed).withField("symbols_failed", symbols).withField("lines_failed", lines))


def host_verdicts(judged: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs; for each rule n_<rule>, rate_<rule> (posterior mean), suspect_<rule>; rejected: one row for each
    host, from one pre-aggregated shuffle.

    The beta prior of a rule comes from the hosts themselves by the method of moments: mean m of all documents,
    variance v of the hosts' rates beyond binomial noise, strength m (1 - m) / v - 1.
    """
    failures = [F.sum(F.col(f"{r}_failed").cast("long")).alias(f"n_{r}") for r in RULES]
    hosts = common.written(judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *failures), "hosts")
    moments = [F.sum("n_docs").alias("n"), F.sum(F.lit(1.0) / F.col("n_docs")).alias("inv"), F.count("*").alias("k")]
    for r in RULES:
        rate = F.col(f"n_{r}") / F.col("n_docs")
        moments += [F.sum(f"n_{r}").alias(f"f_{r}"), F.sum(rate).alias(f"s_{r}"), F.sum(rate * rate).alias(f"ss_{r}")]
    m, out = hosts.agg(*moments).first(), hosts
    for r in RULES:
        a, b = beta_prior(m[f"f_{r}"] or 0, m["n"] or 0, m[f"s_{r}"] or 0.0, m[f"ss_{r}"] or 0.0, m["inv"] or 0.0, m["k"])
        mean = (F.col(f"n_{r}") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
        out = out.withColumn(f"rate_{r}", mean)
        mean = F.col(f"rate_{r}")
        out = out.withColumn(f"suspect_{r}", mean - Z * F.sqrt(mean * (1 - mean) / (F.col("n_docs") + F.lit(a + b + 1))) > SUSPECT_RATE)
    return out.withColumn("rejected", F.col("rate_base") > MAX_HOST_RATE)


def beta_prior(failed: int, docs: int, s: float, ss: float, inverse: float, hosts: int) -> tuple[float, float]:
    m = min(max(failed / docs if docs else 0.5, 0.001), 0.999)
    spread = (ss / hosts - (s / hosts) ** 2 - m * (1 - m) * inverse / hosts) if hosts else 0.0
    strength = m * (1 - m) / spread - 1 if spread > 1e-9 else STRENGTH[1]
    strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
    return m * strength, (1 - m) * strength


def with_verdict(judged: DataFrame, hosts: DataFrame, host: str = "source", text_of: str = "doc_id") -> DataFrame:
    """Adds host_rejected: whether the host is rejected, or suspect for a rule that the document fails.

    Hosts with a verdict are repeated over salts, so that a host of a third of all rows is spread.
    """
    weak = RULES[1:]
    flagged = hosts.where(" OR ".join(["rejected", *(f"suspect_{r}" for r in weak)]))
    bad = flagged.select(F.col("host").alias("_host"), "rejected", *(f"suspect_{r}" for r in weak), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    left = judged.withColumn("_key", F.pmod(F.xxhash64(text_of), F.lit(SALTS)).cast("int"))
    joined = left.join(bad, (left[host] == bad["_host"]) & (left["_key"] == bad["_salt"]), "left")
    verdict = F.col("rejected")
    for r in weak:
        verdict = verdict | (F.col(f"suspect_{r}") & F.col(f"{r}_failed"))
    return joined.withColumn("host_rejected", F.coalesce(verdict, F.lit(False))).drop("_host", "_salt", "_key", "rejected", *(f"suspect_{r}" for r in weak))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, source, the counts, the rules' failures, host_rejected and kept for every document."""
    narrow = features(docs.select("doc_id", "source", "text")).select("doc_id", "source", "rule.*")
    judged = common.written(narrow, "quality")
    out = with_verdict(judged, host_verdicts(judged))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, all columns.

    The rules are judged in one pass, which writes the documents that pass the base rule beside the verdicts of all;
    hosts are added up from the verdicts alone, and only the list of hosts is joined. No text is shuffled.
    """
    held = features(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("source").alias("_source"), F.col("text").alias("_text")), "_text")
    failed = [F.col(f"rule.{r}_failed").alias(f"{r}_failed") for r in RULES]
    judged = common.written(held.select(F.when(~F.col("rule.base_failed"), F.col("_doc")).alias("_doc"), F.col("_source").alias("source"), F.xxhash64("_text").alias("_name"), *failed), "quality")
    out = with_verdict(judged, host_verdicts(judged.select("source", *(f"{r}_failed" for r in RULES))), text_of="_name")
    return out.where("NOT base_failed AND NOT host_rejected").select("_doc.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "symbols_failed", "lines_failed")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (
  SELECT d.doc_id, d.source, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ln.ls) AS BIGINT) AS n_lines, CAST(len(ln.ls) - len(list_distinct(ln.ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words AS symbols_failed, 100 * n_dup_lines > 30 * n_lines AS lines_failed FROM f),
u AS (
  SELECT source, 'base' AS rule, base_failed AS failed FROM b UNION ALL SELECT source, 'symbols', symbols_failed FROM b
  UNION ALL SELECT source, 'lines', lines_failed FROM b),
h AS (SELECT source, rule, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS k FROM u WHERE source IS NOT NULL GROUP BY source, rule),
m AS (SELECT rule, least(greatest(sum(k) / sum(n), 0.001), 0.999) AS m, avg((k / n) * (k / n)) - avg(k / n) * avg(k / n) AS v, avg(1.0 / n) AS inv FROM h GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN v - m * (1 - m) * inv > 1e-9 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM m),
r AS (SELECT source, rule, n, s, (k + m * s) / (n + s) AS mean FROM h JOIN p USING (rule)),
bad AS (SELECT source, rule FROM r WHERE CASE WHEN rule = 'base' THEN mean > 0.8 ELSE mean - 1.2816 * sqrt(mean * (1 - mean) / (n + s + 1)) > 0.04 END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad WHERE rule = 'base'), false)
  AND NOT (symbols_failed AND coalesce(source IN (SELECT source FROM bad WHERE rule = 'symbols'), false))
  AND NOT (lines_failed AND coalesce(source IN (SELECT source FROM bad WHERE rule = 'lines'), false)) AS kept,
  n_lines, symbols_failed, lines_failed
FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": SQL}
