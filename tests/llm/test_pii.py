import hashlib
import re
from collections import Counter

from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    ok = (lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15)
    out = [(m.start(), k, m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in p.finditer(text or "") if ok[k](m[0])]
    names = ("email", "ip", "card", "phone")
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out))
    n = Counter(k for _, k, _ in out)
    return (n[0], n[1], n[2], n[3], hashlib.sha256(joined.encode()).hexdigest()), joined


def check(rows, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows)
    assert got == Counter((i, *brute(t)[0]) for i, t in texts)
    base = {}
    for i, t in texts:
        base.setdefault(i, brute(t)[1])
    for r in rows:
        assert set(filter(None, base[r["doc_id"]].split(","))) <= set(r["spans"].split(","))


CASES = [
    "mail a.b%c@x-y.example.com, a@b@c.d and a@b.c_d@e.f; 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 99999999999999999999.1.1.1",
    "+1 (988) 555-2485 and +49 30 1234567890 +1- 4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559", "é😀 x@y.zz 10.0.0.1 +12345678901234567",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password=b7db7aa4a5fcc78305', "9" * 30_000 + " a" * 100, "x" * 30_000 + "@" + "a-" * 50, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+", "@", "+1 2", "1.1.1.1" * 300,
]


def test_cases(spark, edge, empty):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(CASES)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, edge):
        check(pii.detect(d).collect(), d)
    assert pii.detect(empty).count() == 0


def test_whole_table_and_redaction(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = pii.op7_pii(spark, small).collect()
    check(rows, docs)
    out = pii.stage(spark, docs, small)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r["spans"] for r in rows}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        if not found[r["doc_id"]]:
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert brute(r["text"])[1] == "" and r["n_chars"] == len(r["text"])


def test_secrets_are_added(spark):
    rows = [(i, f"word password=b7db7aa4a5fcc{78305 + i} more words {i}", "en", "s", 1) for i in range(40)] + [(100 + i, f"plain text {i * 7919} 12 34", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    assert all(("secret:5:" in v) == (k < 100) for k, v in got.items())


def test_trees_follow_the_table():
    table = [((4, 1, 2, 0, 1, 1, 0, 2), 90, 100), ((5, 1, 0, 1, 0, 0, 0, 1), 1, 100), ((8, 2, 2, 0, 0, 1, 1, 2), 100, 100)]
    trees, prior, thresholds = pii.fit(table)
    assert pii.predict(trees, prior, table[2][0]) > pii.predict(trees, prior, table[1][0])
    # each kind has its own: 0.90 and 0.01 are below the precision asked for
    assert pii.predict(trees, prior, table[2][0]) >= thresholds[8] and thresholds[4] == thresholds[5] == float("inf")
    assert pii.fit([]) == ([], 0.0, [float("inf")] * len(pii.KINDS)) and 0 < len(pii.chosen(table)) < pii.CELLS


def test_one_kind_does_not_decide_for_another():
    """A thousand sure keys do not carry a hundred secrets of which half are validated."""
    table = [((8, 0, 2, 0, 0, 0, 1, 2), 1000, 1000), ((8, 0, 0, 0, 0, 0, 0, 1), 0, 50), ((4, 0, 2, 0, 1, 0, 1, 2), 50, 100)]
    _, _, thresholds = pii.fit(table, table)
    assert thresholds[4] == float("inf") and thresholds[8] < float("inf")


def test_trust_comes_from_other_kinds():
    email = ((0, 0, 0, 0, 0, 0, 0, 7), 30, 30)  # after word 7
    number = ((5, 0, 0, 0, 0, 0, 0, 7), 0, 30)
    phone = ((3, 0, 0, 0, 0, 0, 0, 9), 0, 60)
    trust = pii.trusts([email, number, phone])
    assert trust[5 * pii.LEADS + 7] == 2 and trust[5 * pii.LEADS + 9] == 0 and trust[5 * pii.LEADS + 8] == 1
    assert trust[7] == 1 and len(trust) == len(pii.KINDS) * pii.LEADS  # numbers alone say little of emails


PLANTED = {
    "secret": ["password=correcthorsebattery", "pwd: 8274619305", 'token: "verysecretwords"'],
    "number": ["030 123456789", "(555) 123-4567", "0171 5550199"],
    "contact": ["jane.roe [at] mail [dot] org", "info(at)firm.net"],
    "account": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"],
    "key": ["0123456789abcdef0123456789abcdef", "9e107d9d372bb682"],
}
DECOYS = ["secret: required", "8305551234567", "noon (at) cafe. Then", "DE00370400440532013000", "GB00 NWBK 6016 1331 9268 19", "1234567890123455", "0000000000000011"]


def test_each_wide_kind_stays_among_decoys(spark):
    rows = [(kind, m, f"word {'tel: ' if kind == 'number' else ''}{m} end") for kind, all_of in PLANTED.items() for m in all_of]
    texts = [t for _, _, t in rows] + [f"word {d} end" for d in DECOYS for _ in range(60)] + [f"mail a{i}@x.example and 10.0.0.{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.detect(docs).collect()}
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, (kind, m, text) in enumerate(rows):
        assert f"{kind}:{text.index(m)}:{text.index(m) + len(m.rstrip(chr(34)))}" in spans[i], text
        assert redacted[i].startswith("word ") and redacted[i].replace('"', "").endswith("] end"), redacted[i]
    for i in range(len(rows), len(rows) + 60 * len(DECOYS)):
        assert redacted[i] == texts[i]


def test_all_positive_takes_all():
    assert len(pii.chosen([((4, 1, 2, 0, 1, 1, 0, 1), 5, 5)])) == pii.CELLS and pii.chosen([((4, 1, 2, 0, 1, 1, 0, 1), 0, 5)]) == set()


def test_long_runs_are_whole_spans(spark):
    word = "aB3" * 40
    cases = [
        ("secret", f"secret={word}"), ("secret", f"token: {word[:36]}.{word[:90]}.{word[:43]}"), ("secret", f"api_key = {word}=="), ("key", "0123456789abcdef" * 8),
        ("contact", "first-name+tag [at] mail [dot] host [dot] org"), ("contact", "x" * 100 + "(at)firm.co.net"), ("secret", "token=" + "a" * 30_000),
    ]
    docs = spark.createDataFrame([(i, f"word {m} end") for i, (_, m) in enumerate(cases)], "doc_id long, text string")
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.detect(docs).collect()}
    for i, (kind, m) in enumerate(cases):
        assert f"{kind}:5:{5 + len(m)}" in spans[i] and re.fullmatch(r"word \[[A-Z]+\] end", redacted[i]), (kind, redacted[i])
    found = pii.candidates(spark.createDataFrame([("12-" * 40 + "1 x",)], "text string")).selectExpr("inline(_found)").where("kind = 5").collect()
    assert [(r["start"], r["end"]) for r in found] == [(0, 121)]


def valid(kind, m, before):
    d = re.sub("[^0-9]", "", m)
    if kind == "secret":
        return bool(re.search("[=:].*[0-9]", m) or (re.search(r"[=:]\x20?[^=:]+[A-Z]", m) and re.search("[=:].*[a-z]", m)) or re.match(r"""[^=:]*(?:=|:\x20?["'])""", m))
    if kind == "number":
        return 7 <= len(d) <= 15 and bool(re.search(pii._CALL, before))
    if kind == "contact":
        return not re.search(r"\x20\.|\.\x20", m) and bool(re.search(r"(?i)[^a-z0-9-][a-z]{2,24}$", m))
    if kind == "account":
        a = m.replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in a[4:] + a[:4])
        return a[:2] in dict((c, n) for n, all_of in pii.IBAN.items() for c in all_of.split("|")) and {c: n for n, all_of in pii.IBAN.items() for c in all_of.split("|")}[a[:2]] == len(a) and int(turned) % 97 == 1
    if kind == "key":
        return bool(re.search("[0-9]", m) and re.search("[a-f]", m))
    return {"ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}.get(kind, True)


def brute_candidates(text):
    """(start, kind, end, valid, features) of every candidate, one match after the other."""
    import regex
    import xxhash

    out = []
    for k, (kind, pattern) in enumerate(pii.BASE + pii.WIDE):
        last = 0
        for m in regex.finditer(pattern, text):
            before = text[last : m.start()][-24:]
            last, x = m.end(), m[0]
            digits, n = len(re.sub("[^0-9]", "", x)), len(x)
            marks = len(re.findall(r"[\x20().:=/@-]", x))
            context = bool(re.search(pii.CONTEXT, before)) or bool(re.match(r"(?i)(?:password|passwd|pwd|secret|token|api|access)", x))
            mixed = bool(re.search("[0-9]", x) and re.search("[A-Za-z]", x))
            features = {"digits": sum(digits >= b for b in (8, 14, 20)), "length": sum(n >= b for b in (12, 20, 32)), "marks": min(marks, 2), "context": int(context), "mixed": int(mixed)}
            words = re.findall("[A-Za-z]+", before)
            h = xxhash.xxh64(words[-1].lower().encode(), seed=42).intdigest() if words else 0
            lead = (h - (h >> 63 << 64)) % (pii.LEADS - 1) + 1 if words else 0
            out.append((m.start(), k, m.end(), valid(kind, x, before), (k, *(0 if f in pii.HIDDEN[kind] else v for f, v in features.items())), lead))
    kinds = {c[1] for c in out if c[3]}
    return [(*c[:4], (*c[4], int(bool(kinds - {c[1]})), c[5])) for c in sorted(out)]


def test_added_spans_by_brute_force(spark, small):
    """The cells' counts, the trees' scores and every span of every document, against a plain loop over all pairs."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, t) for i, t in enumerate(CASES + [x for v in PLANTED.values() for x in v] + DECOYS) if len(t) < 5000]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("text", docs["text"]).cache()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    brute_of = {i: brute_candidates(t) for i, t in texts.items()}
    first, second = pii.cells(pii.candidates(docs))
    want = Counter()
    for found in brute_of.values():
        for c in found:
            if c[3] or not any(g[3] and g[0] < c[2] and c[0] < g[2] for g in found):
                want[c[4]] += 1
                want[c[4], "y"] += c[3]
    got = Counter()
    for x, y, n in first + second:
        got[x] += n
        got[x, "y"] += y
    assert +got == +want
    trust = pii.trusts(first)
    trees, prior, thresholds = pii.fit(pii.trusting(first, trust), pii.trusting(second, trust))

    def added(c, found):
        x = (*c[4][:-1], trust[c[1] * pii.LEADS + c[4][-1]])
        inside = any(g[3] and g[0] <= c[0] and c[2] <= g[2] for g in found)
        return not c[3] and c[1] >= len(pii.BASE) and not inside and pii.predict(trees, prior, x) >= thresholds[c[1]]

    rows = pii.detect(docs).collect()
    for r in rows:
        found = brute_of[r["doc_id"]]
        more = [c for c in found if added(c, found)]
        spans = [f"{pii.KINDS[c[1]]}:{c[0]}:{c[2]}" for c in found if c[3] or c in more]
        assert r["spans"] == ",".join(spans) and r["n_added"] == len(more), r["doc_id"]
    quality = pii.report(pii.trusting(first, trust), pii.trusting(second, trust))
    assert all(p >= pii.PRECISION or n == 0 for n, p, *_ in quality.values())


def test_hidden_truth_is_found_by_context(spark):
    """Numbers that no validation knows, after a word that telephone numbers follow in other documents, are added; the
    same numbers after other words are not."""
    texts = [f"notes {i} reach +49 30 {1000000 + i * 37} and mail a{i}@x.example" for i in range(300)]
    texts += [f"notes {i} dial tel {2000000 + i * 41} and mail b{i}@x.example" for i in range(300)]
    texts += [f"notes {i} dial tel +49 40 {3000000 + i * 43} and mail c{i}@x.example" for i in range(300)]
    planted = range(len(texts), len(texts) + 8)
    texts += [f"notes {i} reach {5550100 + i} and mail d{i}@x.example" for i in range(8)]
    decoys = range(len(texts), len(texts) + 300)
    texts += [f"notes {i} invoice {7000000 + i * 47} and mail e{i}@x.example" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert all("number:" in rows[i]["spans"] and rows[i]["n_added"] == 1 for i in planted)
    assert not any("number:" in rows[i]["spans"] or rows[i]["n_added"] for i in decoys)


def test_many_matches_in_one_text(spark):
    """A text of a megabyte with 80,000 matches takes seconds; redaction keeps what lies between."""
    import time

    text = "12345678 ab " * 80_000
    docs = spark.createDataFrame([(1, text), (2, "mail a@b.cc " * 20_000), (3, "plain")], "doc_id long, text string")
    start = time.time()
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert rows[2]["n_email"] == 20_000 and rows[3]["spans"] == ""
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[2] == "mail [EMAIL] " * 20_000 and out[3] == "plain" and time.time() - start < 60
