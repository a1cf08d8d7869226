"""Personal data: high-recall generators, boosted trees over format and context, a calibrated threshold a kind.

Base kinds (email, ip, card, phone) are matched and validated as they stand; their spans always stay. Wider
generators propose overlapping spans, each kind with its own validation (see _valid); what passes it stays too. The
trees decide on the rest. They learn which candidates are validated, but do not see what a kind's validation reads
(HIDDEN); what they see is the remaining format, whether the document holds validated spans of other kinds, and trust:
how often candidates of the other kinds are validated after the same word, in all documents of the half that is fitted.
So a word that stands before telephone numbers or addresses elsewhere speaks for a candidate that no validation knows.
Candidates that overlap a validated span are not learned from, and those inside one are not added.

Every candidate is put in a cell of binned features and its leading word's hash, one of LEADS. The cells' counts over
all documents are one aggregate of at most 2 RAW_CELLS rows: a hash of the text deals documents into two halves.
Gradient-boosted trees are fitted on the driver to the first half; for each kind the threshold is the lowest at which
the chosen cells of the second, held-out half reach PRECISION. A kind without validated candidates there adds nothing;
if every candidate of all kinds is validated, all are taken. Candidates that should have been validated count as wrong,
so the precision is a lower bound. The trees go back as CASE expressions. All work on rows is in built-in expressions,
linear in a text but for a logarithm of its number of candidates.

Defined results: a null text is empty and has no spans; offsets count code points, ends are exclusive; repeated
rows and rows of a null doc_id are judged each; without candidates nothing is added; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base kinds in order. Possessive loops and look-behind change no match, only the cost.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: The countries by the length of their account numbers (IBAN).
IBAN = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])|" for n, c in IBAN.items())
#: The wider generators in order. Their runs are open-ended: a span never stops inside a longer run.
WIDE = (
    ("secret", r"""(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\x20?[=:]\x20?["']?[A-Za-z0-9+/_-]{8,}+(?:\.[A-Za-z0-9+/_-]++)*+={0,2}+"""),
    ("number", r"(?<![0-9])[0-9(](?:[\x20().-]{0,2}+[0-9]){6,}+"),
    ("contact", r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[a-z0-9-]++\x20?(?:\.|[(\[]dot[)\]])\x20?[a-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[a-z0-9-]++)*+"),
    ("account", r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + _BY_LENGTH + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9]))"),
    ("key", r"(?<![A-Za-z0-9])[0-9a-f]{16,}+(?![A-Za-z0-9])"),
)
KINDS = [k for k, _ in BASE + WIDE]
CONTEXT = r"(?i)(?:phone|tel|fax|mail|contact|card|visa|account|iban|ssn|password|passwd|secret|token|key|ip|address)[\x20:=\x22#.]{0,4}$"
_CALL = r"(?i)(?:phone|(?<![a-z])(?:tel|telefon|tel[e\u00e9]fono|t[e\u00e9]l|fax|mobile|mobil|cell|handy|call))(?:\x20(?:number|no|nr))?[\x20:=\x22#.]{0,4}$"
#: The last word before a candidate.
_LEAD = r"(?i)([a-z]++)[^a-z]*+$"
#: Features and how many values each has; their product bounds the training table.
BINS = {"kind": len(KINDS), "digits": 4, "length": 4, "marks": 3, "context": 2, "mixed": 2, "company": 2, "trust": 3}
CELLS = math.prod(BINS.values())
#: In the table, trust is still the hash of the leading word; 0 is none.
LEADS = 64
RAW = [*list(BINS)[:-1], "lead"]
RAW_CELLS = CELLS // BINS["trust"] * LEADS
#: What the trees do not see of a kind, as its validation reads it.
HIDDEN = {
    "email": ("marks",), "ip": ("digits", "length", "marks"), "card": ("digits", "length"), "phone": ("digits", "length"),
    "secret": ("digits", "marks", "mixed"), "number": ("digits", "length", "context"), "contact": ("marks",), "account": ("digits", "length"), "key": ("digits", "mixed"),
}
ROUNDS, RATE, PRECISION = 16, 0.4, 0.95
#: Code points of the chunks in which a text is cut for redaction.
WINDOW = 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(d: Column, i: Column) -> Column:
        v = F.ascii(d) - 48
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _iban(m: Column) -> Column:
    """Whether the country is known, the length is the country's and the remainder by 97 is 1."""
    a = F.regexp_replace(m, r"\x20", "")
    form = "|".join(f"(?:{c})[0-9]{{2}}[A-Z0-9]{{{n - 4}}}" for n, c in IBAN.items())

    def step(r: Column, x: Column) -> Column:
        v = F.ascii(x)
        return F.when(v < 58, r * 10 + v - 48).otherwise(r * 100 + v - 55) % 97

    turned = F.concat(F.substring(a, 5, 40), F.substring(a, 1, 4))
    return F.when(a.rlike(f"^(?:{form})$"), F.aggregate(F.split(turned, ""), F.lit(0), step) == 1).otherwise(False)


def _valid(kind: str, m: Column, before: Column) -> Column:
    """secret: holds a digit, mixes case after its first character, or is assigned or quoted; number: 7 to 15 digits after a word for a telephone;
    contact: no blanks around a bare dot, letters at the end; account: see _iban; key: letters and digits."""
    d = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.try_to_number(F.right(F.regexp_replace(p, "^0+(?=[0-9])", ""), F.lit(4)), F.lit("9999")), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    if kind == "secret":
        return m.rlike("[=:].*[0-9]") | (m.rlike(r"[=:]\x20?[^=:]+[A-Z]") & m.rlike("[=:].*[a-z]")) | m.rlike(r"""^[^=:]*(?:=|:\x20?["'])""")
    if kind == "number":
        return F.length(d).between(7, 15) & before.rlike(_CALL)
    if kind == "contact":
        return ~m.rlike(r"\x20\.|\.\x20") & m.rlike(r"(?i)[^a-z0-9-][a-z]{2,24}$")
    if kind == "account":
        return _iban(m)
    if kind == "key":
        return m.rlike("[0-9]") & m.rlike("[a-f]")
    return F.lit(True)


def _described(text: Column, kind: str, pattern: str) -> Column:
    """Candidates of one kind with their binned features."""
    number = KINDS.index(kind)
    at = common.matches(text, pattern)

    def one(x: Column) -> Column:
        m = x["m"]
        n, digits = F.length(m), F.length(_digits(m))
        marks = F.length(F.regexp_replace(m, r"[^\x20().:=/@-]", ""))
        before = F.right(x["before"], F.lit(24))
        context = before.rlike(CONTEXT) | m.rlike(r"(?i)^(?:password|passwd|pwd|secret|token|api|access)")
        valid = _valid(kind, m, before)
        word = F.lower(F.regexp_extract(before, _LEAD, 1))
        features = {
            "digits": F.when(digits < 8, 0).when(digits < 14, 1).when(digits < 20, 2).otherwise(3),
            "length": F.when(n < 12, 0).when(n < 20, 1).when(n < 32, 2).otherwise(3),
            "marks": F.least(marks, F.lit(2)), "context": context.cast("int"), "mixed": (m.rlike("[0-9]") & m.rlike("[A-Za-z]")).cast("int"),
        }
        return F.struct(
            # of equal starts the validated ones come first
            x["start"].alias("start"), (~valid).cast("int").alias("open"), F.lit(number).alias("kind"), x["end"].alias("end"),
            (valid if number < len(BASE) else F.lit(False)).alias("base"), valid.alias("valid"),
            *((F.lit(0) if k in HIDDEN[kind] else c).alias(k) for k, c in features.items()),
            F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(LEADS - 1)).cast("int") + 1).alias("lead"),
        )

    return F.transform(at, one)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _found: every candidate of every kind by start, validated ones first. Kinds whose signs a text lacks are
    matched against nothing."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.lit("")
    signs = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "contact": t.rlike(r"(?i)[(\[]at[)\]]"), "secret": t.rlike(r"(?i)(?:password|passwd|pwd|secret|token|key)\x20?[=:]")}
    any_digit = t.rlike("[0-9]")
    out = docs.withColumns({f"_t_{k}": F.when(signs.get(k, any_digit), t).otherwise(none) for k in KINDS})
    out = out.withColumn("_found", F.sort_array(F.concat(*(_described(F.col(f"_t_{k}"), k, p) for k, p in BASE + WIDE)))).drop(*(f"_t_{k}" for k in KINDS))
    valid = F.array_distinct(F.transform(F.filter("_found", lambda c: c["valid"]), lambda c: c["kind"]))
    company = common.let(valid, lambda v: F.transform("_found", lambda c: c.withField("company", (F.size(F.array_remove(v, c["kind"])) > 0).cast("int"))))
    plain = lambda c: c.withField("company", F.lit(0)).withField("near", F.lit(False)).withField("inside", F.lit(False))
    return out.withColumn("_found", F.when(F.size("_found") > 0, _placed(company)).otherwise(F.transform("_found", plain)))


def _placed(found: Column) -> Column:
    """Adds near and inside: does a candidate that is not validated (of an array by start) overlap a validated one, does
    it lie inside one?"""
    ends = F.transform(found, lambda c: F.when(c["valid"], c["end"]))
    starts = F.reverse(F.transform(found, lambda c: F.when(c["valid"], c["start"])))
    reach = F.struct(common.scanned(ends, F.greatest).alias("before"), common.scanned(starts, F.least).alias("after"), F.size(found).alias("n"))

    def all_of(x: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.get(x["before"], i - 1)
            near = F.coalesce(before > c["start"], F.lit(False)) | F.coalesce(F.get(x["after"], x["n"] - i - 2) < c["end"], F.lit(False))
            inside = F.coalesce(before >= c["end"], F.lit(False))
            return c.withField("near", near & ~c["valid"]).withField("inside", inside & ~c["valid"])

        return F.transform(found, one)

    return common.let(reach, all_of)


Cells = list[tuple[tuple[int, ...], int, int]]


def cells(found: DataFrame, text: str = "text") -> tuple[Cells, Cells]:
    """(RAW features, validated, candidates) of each cell, of either half of the documents: one pre-aggregated shuffle,
    at most 2 RAW_CELLS rows."""
    half = F.pmod(F.xxhash64(text), F.lit(2)).alias("half")
    # an outer generator: of the other one the optimizer would infer a filter, and compute all candidates once more for it
    rows = found.select(half, F.filter("_found", lambda c: ~c["near"]).alias("_y")).select("half", F.inline_outer("_y")).where("kind is not null")
    rows = rows.groupBy("half", *RAW).agg(F.count_if("valid").alias("y"), F.count("*").alias("n")).collect()
    first, second = (sorted((tuple(r[f] for f in RAW), r["y"], r["n"]) for r in rows if r["half"] == k) for k in (0, 1))
    return first, second


def trusts(table: Cells) -> list[int]:
    """For each kind and leading word, at kind * LEADS + word: 2 where candidates of the other kinds after this word are
    validated far more often than all of them, 0 where far less often, else 1, as where there are none."""
    out = []
    for kind in range(len(KINDS)):
        y, n = [0] * LEADS, [0] * LEADS
        for x, good, count in table:
            if x[0] != kind:
                y[x[-1]] += good
                n[x[-1]] += count
        overall = sum(y) / max(sum(n), 1)
        for good, count in zip(y, n, strict=True):
            share = (good + overall) / (count + 1)  # shrunk by one candidate
            out.append(1 if not count else 2 if share >= (1 + overall) / 2 else 0 if share < overall / 2 else 1)
    return out


def trusting(table: Cells, trust: list[int]) -> Cells:
    """The table with the trust in each leading word in its place."""
    out: dict[tuple[int, ...], tuple[int, int]] = {}
    for x, y, n in table:
        key = (*x[:-1], trust[x[0] * LEADS + x[-1]])
        a, b = out.get(key, (0, 0))
        out[key] = (a + y, b + n)
    return sorted((x, y, n) for x, (y, n) in out.items())


def fit(table: Cells, held: Cells | None = None, rounds: int = ROUNDS) -> tuple[list, float, list[float]]:
    """Trees of depth two ((f, at), (f, at, w, w), (f, at, w, w)), the prior log-odds and each kind's threshold on the score.

    held: the cells of the half that calibrates the threshold; where it has no candidate of a wide kind, or the other
    half has none at all, both calibrate and fit. There are no trees where all labels are equal: the thresholds then take nothing or, if all are positive, everything."""
    if held is None or not table or not any(x[0] >= len(BASE) for x, _, _ in held):
        table = held = sorted([*table, *(held or [])])
    total, good = sum(n for _, _, n in table), sum(y for _, y, _ in table)
    if not good or good == total:
        return [], 0.0, [-math.inf if good else math.inf] * len(KINDS)
    prior = math.log(good / (total - good))
    score = [prior] * len(table)
    options = [(f, at) for f, size in enumerate(BINS.values()) for at in range(size - 1)]
    trees = []

    def leaf(part: list[int], g: list[float], h: list[float]) -> tuple[float, float]:
        a, b = sum(g[i] for i in part), sum(h[i] for i in part) + 1.0
        return a * a / b, RATE * a / b

    def split(part: list[int], g: list[float], h: list[float]) -> tuple[float, int, int, list[int], list[int]]:
        best = None
        for f, at in options:
            left = [i for i in part if table[i][0][f] <= at]
            right = [i for i in part if table[i][0][f] > at]
            gain = leaf(left, g, h)[0] + leaf(right, g, h)[0]
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, at, left, right)
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [y - n * q for (_, y, n), q in zip(table, p, strict=True)]
        h = [n * q * (1 - q) for (_, _, n), q in zip(table, p, strict=True)]
        _, f, at, *sides = split(list(range(len(table))), g, h)
        tree = [(f, at)]
        for side in sides:
            _, f2, at2, left, right = split(side, g, h)
            weights = [leaf(x, g, h)[1] for x in (left, right)]
            tree.append((f2, at2, *weights))
            for part, w in zip((left, right), weights, strict=True):
                for i in part:
                    score[i] += w
        trees.append(tuple(tree))
    thresholds = [math.inf] * len(KINDS)
    for kind in range(len(BASE), len(KINDS)):
        by_score: dict[float, tuple[int, int]] = {}
        for x, y, n in held:
            if x[0] == kind:
                at = round(predict(trees, prior, x), 9)
                a, b = by_score.get(at, (0, 0))
                by_score[at] = (a + y, b + n)
        count = right = 0
        for at in sorted(by_score, reverse=True):
            right, count = right + by_score[at][0], count + by_score[at][1]
            if right >= PRECISION * count:
                thresholds[kind] = max(at - 1e-8, 0.0)
    return trees, prior, thresholds


def predict(trees: list, prior: float, x: tuple[int, ...]) -> float:
    total = prior
    for (f, at), left, right in trees:
        f2, at2, a, b = left if x[f] <= at else right
        total += a if x[f2] <= at2 else b
    return total


def chosen(table: Cells) -> set[int]:
    """The numbers of all cells, seen or not, whose score reaches their kind's threshold."""
    trees, prior, thresholds = fit(table)
    return {n for n, x in enumerate(product(*(range(b) for b in BINS.values()))) if predict(trees, prior, x) >= thresholds[x[0]]}


def report(table: Cells, held: Cells) -> dict[str, tuple[int, float, float, int]]:
    """For each wide kind, the held-out candidates, the precision and recall of the trees alone against validation, and
    how many candidates outside all validated spans they add."""
    trees, prior, thresholds = fit(table, held)
    out = {}
    for k, name in enumerate(KINDS):
        rows = [(predict(trees, prior, x) >= thresholds[k], y, n) for x, y, n in held if x[0] == k >= len(BASE)]
        taken, right, good = sum(n for t, _, n in rows if t), sum(y for t, y, _ in rows if t), sum(y for _, y, _ in rows)
        if rows:
            out[name] = (sum(n for _, _, n in rows), right / taken if taken else 1.0, right / good if good else 1.0, taken - right)
    return out


def score_expression(trees: list, prior: float, c: Column) -> Column:
    """The trees as nested CASE expressions over a candidate's features."""
    names = list(BINS)
    total = F.lit(prior)
    for (f, at), left, right in trees:
        sides = [F.when(c[names[f2]] <= at2, a).otherwise(b) for f2, at2, a, b in (left, right)]
        total = total + F.when(c[names[f]] <= at, sides[0]).otherwise(sides[1])
    return total


def learned(found: DataFrame, text: str = "text") -> tuple[list[int], list, float, list[float]]:
    """The trust in leading words, the trees, the prior and the thresholds of these documents' candidates."""
    first, second = cells(found, text)
    trust = trusts(first or second)
    return trust, *fit(trusting(first, trust), trusting(second, trust))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _spans: struct(start, kind, end, base, added), the validated spans and what the trees add, by start, then kind."""
    found = candidates(docs, text)
    trust, trees, prior, thresholds = learned(found, text)
    words, least = F.array(*map(F.lit, trust)), F.array(*map(F.lit, thresholds))

    def keep(c: Column) -> Column:
        more = score_expression(trees, prior, c.withField("trust", F.get(words, c["kind"] * LEADS + c["lead"]))) >= F.get(least, c["kind"])
        return c["valid"] | ((c["kind"] >= len(BASE)) & ~c["inside"] & more)

    slim = F.transform(F.filter("_found", keep), lambda c: F.struct(c["start"], c["kind"], c["end"], c["base"], (~c["valid"]).alias("added")))
    return found.withColumn("_spans", F.sort_array(slim)).drop("_found")


def _written(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans that are there by the trees alone)."""
    out = spans(docs.select("doc_id", "text"))
    base = F.filter("_spans", lambda x: x["base"])
    counts = [F.size(F.filter("_spans", _of(k))).cast("long").alias(f"n_{name}") for k, (name, _) in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"), F.size(F.filter("_spans", lambda x: x["added"])).cast("long").alias("n_added"))


def _of(number: int):
    return lambda x: x["base"] & (x["kind"] == number)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one.

    A span is written where it begins after all spans before it end. What stays of the text is taken from chunks of
    WINDOW code points, so that its cost does not grow with its place.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    t = F.col(text)

    def between(chunks: Column, a: Column, b: Column) -> Column:
        """Code points a to b (exclusive)."""
        i, j = (F.floor(x / WINDOW).cast("int") for x in (a, b))
        first, last = F.coalesce(F.get(chunks, i), F.lit("")), F.coalesce(F.get(chunks, j), F.lit(""))
        inner = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        apart = F.concat(F.substring(first, a % WINDOW + 1, F.lit(WINDOW)), inner, F.substring(last, F.lit(1), b % WINDOW))
        return F.when(i == j, F.substring(first, a % WINDOW + 1, b - a)).otherwise(apart)

    def rewritten(x: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            at = F.coalesce(F.get(x["reach"], i - 1), F.lit(0))
            return F.when(c["start"] >= at, F.concat(between(x["chunks"], at, c["start"]), F.get(names, c["kind"]))).otherwise(F.lit(""))

        rest = between(x["chunks"], F.element_at(x["reach"], -1), F.length(t))
        return F.concat(F.array_join(F.transform("_spans", piece), ""), rest)

    reach = common.scanned(F.transform("_spans", lambda c: c["end"]), F.greatest)
    both = F.struct(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0)).alias("chunks"), reach.alias("reach"))
    return spans(docs, text).withColumn(text, F.when(F.size("_spans") > 0, common.let(both, rewritten)).otherwise(t)).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.read(spark, sf_dir, "documents"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
