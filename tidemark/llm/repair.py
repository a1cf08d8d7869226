"""Repair of conversations' turn structure by weighted CYK interval parsing.

The roles of a sound conversation spell `(s?(ua)+)?`. The repair grammar is in Chomsky normal form; its non-terminals
are the factors of that language, named by the two ends of a factor: (p, q) derives what leads from p to q, where the
ends are start (nothing yet), after a system row, after a user row, after an assistant row:

    (p, q) -> (p, r) (r, q)        any r
    (p, q) -> a row kept or reroled whose initial leads from p to q
    (p, p) -> a row deleted
    (p, q) -> nothing              the insertion closure: rows inserted on the way from p to q

A cell of a span holds the least (cost, audit) of each non-terminal. A cost is a function of its audit, so that no
audit of a span is the beginning of another of equal cost, and least cells join to least cells. As the non-terminals
are all factors of the language, every split of a span gives the same cell; one split a span is enough, and the chart
is filled bottom-up over spans of 1, 2, 4, ... rows: n cells, not n^2. A conversation of any length is cut into spans
of SPAN rows in its order, each parsed by itself; the cells of up to SPAN spans are joined in the same way, then those.

Defined results: a null role or text is one space, a null conv_id is a conversation of its own, null turns come first;
rows of one turn are ordered by role, text. An empty role has no initial and fits nowhere. Initials are compared in
exact case. A gap count beyond a long is null. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

SPAN_BITS = 10
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: (p, q) by the initial that leads from p to q.
STEPS = {(START, SYSTEM): "s", (START, USER): "u", (SYSTEM, USER): "u", (USER, ASSISTANT): "a", (ASSISTANT, USER): "u"}
CLASSES = "suax"
LEGAL = {"su", "ua", "au"}
Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """(p, q) -> (p, r) (r, q), the least of all r."""
    out: Cell = {}
    for (p, r), (a, x) in left.items():
        for (s, q), (b, y) in right.items():
            if r == s and ((p, q) not in out or (a + b, x + y) < out[p, q]):
                out[p, q] = (a + b, x + y)
    return out


def _closure() -> Cell:
    """The cell of an empty span: rows inserted from p to q."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        more = joined(out, out | {k: (INSERT, "I") for k, c in STEPS.items() if c != "s"})
        if more == out:
            return out
        out = more


EMPTY = _closure()


@lru_cache(maxsize=64)
def leaf(sign: str) -> Cell:
    """The cell of one row. sign: the class of its initial, in lower case where sound, in upper case where truncated, a
    digit (its place among CLASSES) where it must be deleted."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if not sign.isdigit():
        cut = CUT if sign.isupper() else 0
        for (p, q), c in STEPS.items():
            if c == sign.lower():
                cell[p, q] = (KEEP + cut, "K")
            elif c != "s":
                cell[p, q] = (REROLE + cut, "R")
    return joined(joined(EMPTY, cell), EMPTY)


def bottom_up(cells: list[Cell]) -> Cell:
    """Adjacent cells joined two by two until one spans all."""
    while len(cells) > 1:
        cells = [joined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


@lru_cache(maxsize=1 << 14)
def _short(signs: str) -> Cell:
    return bottom_up([leaf(c) for c in signs])


def parsed(signs: str) -> Cell:
    """The cell of a span of rows; those of short pieces are remembered, since they recur."""
    return bottom_up([_short(signs[k : k + 8]) for k in range(0, len(signs), 8)])


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[k] for k in ((START, START), (START, ASSISTANT)) if k in cell)


def initials(signs: str) -> str:
    return "".join(CLASSES[int(c)] if c.isdigit() else c.lower() for c in signs)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows dropped, emptied, stripped of marks, repeated or reroled by crc32 of their key."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = plain(df).withColumn("_d", F.crc32(key) % 20).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_c")).drop("_c")


def plain(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def placed(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos: pos grows along each conversation. Written; a long one is spread over tasks."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = plain(df).repartitionByRange(*order).sortWithinPartitions(*order)
    return common.written(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, fault (blank, duplicate, truncated or null: the first that applies) and sign, see leaf()."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    seen = rows.withColumn("blank", blank)
    # the first place of each text; joined by places, which are unique, so that no text can be a hot key
    first = seen.where("NOT blank").groupBy("conv_id", same.alias("same")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    group = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = seen.select("conv_id", "turn", "pos", "blank", cut.alias("cut"), group.alias("class"))
    slim = slim.join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    must, place = fault.isin("blank", "duplicate"), (F.instr(F.lit(CLASSES), F.col("class")) - 1).cast("string")
    sign = F.when(must, place).when(fault.isNotNull(), F.upper("class")).otherwise(F.col("class"))
    return slim.select("conv_id", "turn", "pos", fault.alias("fault"), sign.alias("sign"))


CELL = "array<struct<p:int,q:int,cost:bigint,audit:string>>"


def _mapped(df: DataFrame, schema: str | StructType, f) -> DataFrame:
    """f(columns of a batch as lists) -> lists of the schema's columns."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(f(*(c.to_pylist() for c in b.columns)), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _listed(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def _cell(listed: list[dict]) -> Cell:
    return {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in listed}


def parses(signs: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal of rows conv_id, pos, sign."""
    kind = signs.schema["conv_id"]
    some = StructType([kind]).add("span", "long").add("first", "string").add("last", "string").add("illegal", "long")
    level = StructType([*some.fields, *StructType.fromDDL(f"cell {CELL}").fields])

    def rows(conv: list, span: list, text: list) -> tuple:
        names = [initials(t) for t in text]
        bad = [sum(n[k : k + 2] not in LEGAL for k in range(len(n) - 1)) for n in names]
        return conv, span, [n[0] for n in names], [n[-1] for n in names], bad, [_listed(parsed(t)) for t in text]

    def spans(conv: list, span: list, parts: list) -> tuple:
        bad = [sum(x["illegal"] for x in p) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(p, p[1:])) for p in parts]
        cells = [_listed(bottom_up([_cell(x["cell"]) for x in p])) for p in parts]
        return conv, span, [p[0]["first"] for p in parts], [p[-1]["last"] for p in parts], bad, cells

    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sign"))), lambda x: x["sign"]), "")
    out = _mapped(signs.groupBy("conv_id", F.shiftright("pos", SPAN_BITS).alias("span")).agg(text.alias("text")), level, rows)
    part = F.sort_array(F.collect_list(F.struct("span", "first", "last", "illegal", "cell")))
    # spans of 2^10 and 2^20 rows, then the rest: as many as a conversation has of the latter
    for bits in (SPAN_BITS, 63):
        out = _mapped(out.groupBy("conv_id", F.shiftright("span", bits).alias("wide")).agg(part.alias("part")), level, spans)

    def least(conv: list, illegal: list, cells: list) -> tuple:
        found = [best(_cell(c)) for c in cells]
        return conv, [c for c, _ in found], [a for _, a in found], illegal

    return _mapped(out.select("conv_id", "illegal", "cell"), StructType([kind]).add("cost", "long").add("audit", "string").add("illegal", "long"), least)


def verdicts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of placed rows."""
    marked = common.written(faults(rows), "faults")
    count = lambda k: F.count_if(F.coalesce(F.col("fault") == k, F.lit(False)))
    turns = marked.groupBy("conv_id", "turn").agg(*(count(k).alias(k) for k in ("blank", "duplicate", "truncated")))
    wide = F.col("hi").cast("decimal(38,0)") - F.col("lo").cast("decimal(38,0)") + 1 - F.col("n").cast("decimal(38,0)")
    counts = turns.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("n"), *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")))
    counts = counts.select("conv_id", F.when(F.col("lo").isNull(), F.lit(0).cast("long")).otherwise(wide.try_cast("long")).alias("gaps"), "blank", "duplicate", "truncated")
    found = parses(marked).withColumnRenamed("conv_id", "_id")
    return counts.join(found, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def _roles(audit: str) -> Iterator[tuple[str, str | None]]:
    """Each edit with the role of the row it gives, None for a deleted one or the system row."""
    n = sum(c != "D" for c in audit)
    k = -(n % 2)
    for c in audit:
        yield c, None if c == "D" or k < 0 else ("user", "assistant")[k % 2]
        k += c != "D"


VERDICT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _stream(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's head (its verdict), then its rows in order, in one partition and never held together."""
    keys = heads.select("conv_id", F.lit(-1).cast("long").alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))), *VERDICT)
    types = dict(heads.dtypes)
    body = rows.select("conv_id", "pos", F.col("turn").cast("long").alias("turn"), "role", "text", *(F.lit(None).cast(types[c]).alias(c) for c in VERDICT))
    return keys.unionByName(body).repartition(common.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(head, None) where a conversation begins, then (edit, turn, role, text) for each edit in order."""
    edits: Iterator | None = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["pos"] == -1:
                for c, role in edits or ():
                    yield c, None, role, ""
                edits = _roles(r["audit"])
                yield r, None
                continue
            for c, role in edits:
                if c == "I":
                    yield c, None, role, ""
                    continue
                yield c, r["turn"], r["role"] if c in "KD" else role, r["text"]
                break
    for c, role in edits or ():
        yield c, None, role, ""


def repaired(df: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role, text: the repaired conversations' rows in order, from 0; deleted ones are left out."""
    rows = placed(df)
    schema = StructType([df.schema["conv_id"]]).add("place", "long").add("edit", "string").add("turn", "long").add("role", "string").add("text", "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, place = None, 0
        for e in _edits(batches):
            if e[1] is None and len(e) == 2:
                conv, place = e[0]["conv_id"], 0
            elif e[0] != "D":
                out.append((conv, place, *e))
                place += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in out], schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x, strict=True)) for x in out], schema=arrow)

    return _stream(verdicts(rows), rows).mapInArrow(run, schema)


def repair(df: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row a conversation: its faults, the cheapest repair and the hash of the repaired `role:text` lines.

    every: the conv_ids to report where they go beyond those of df; one without rows has zeros and an empty repair.
    """
    rows = placed(df)
    heads = verdicts(rows)
    if every is not None:
        ids = every.select(F.col("conv_id").alias("_id")).distinct()
        zero = {c: F.coalesce(F.when(F.col("cost").isNull(), F.lit("" if c == "audit" else 0)), F.col(c)) for c in VERDICT if c != "cost"}
        heads = ids.join(heads, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_id", "conv_id")
        heads = heads.withColumns(zero).withColumn("cost", F.coalesce("cost", F.lit(0).cast("long")))
    schema = StructType([df.schema["conv_id"], *heads.select(*VERDICT).schema.fields]).add("repaired_sha256", "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, out = None, None, []

        def done() -> list:
            return [] if head is None else [{**{k: head[k] for k in ("conv_id", *VERDICT)}, "repaired_sha256": digest.hexdigest()}]

        for e in _edits(batches):
            if len(e) == 2:
                out += done()
                head, digest, begun = e[0], hashlib.sha256(), False
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            elif e[0] != "D":
                digest.update(f"{chr(10) if begun else ''}{e[2]}:{e[3]}".encode())
                begun = True
        yield pa.RecordBatch.from_pylist(out + done(), schema=arrow)

    return _stream(heads, rows).mapInArrow(run, schema)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = common.read(spark, sf_dir, "conversations")
    return repair(damaged(df), df)


def _sql() -> str:
    """The twin: a recursion over the rows' ranks whose state is one (cost, audit) for each end."""
    pick = lambda v, cost, letter: f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}'}}"
    never = "{'c': CAST(1000000000000 AS BIGINT), 'a': '~'}"
    kept = lambda v, c: f"CASE WHEN NOT must AND class = '{c}' THEN {pick(v, 'cut', 'K')} ELSE {never} END"
    moved = lambda v: f"CASE WHEN NOT must THEN {pick(v, '3 + cut', 'R')} ELSE {never} END"
    gone = lambda v: pick(v, 4, "D")
    ends = {
        "s": gone("s"),
        "y": f"least({gone('y')}, {kept('s', 's')})",
        "u": f"least({gone('u')}, " + ", ".join(f"{kept(v, 'u')}, {moved(v)}" for v in "sya") + ")",
        "a": f"least({gone('a')}, {kept('u', 'a')}, {moved('u')})",
    }
    closed = {
        "s": "s", "y": "y", "u": f"least(u, {pick('s', 3, 'I')}, {pick('y', 3, 'I')}, {pick('a', 3, 'I')})",
        "a": f"least(a, {pick('u', 3, 'I')}, {pick('s', 6, 'II')}, {pick('y', 6, 'II')})",
    }
    names = ", ".join("syua")
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (
  SELECT p.*, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS d
  FROM plain p, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE d <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM hurt),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open, substr(role, 1, 1) AS class, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM ranked),
turns AS (SELECT *, blank OR again AS must, CASE WHEN open THEN 3 ELSE 0 END AS cut FROM marked),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS s, {never} AS y, {{'c': CAST(3 AS BIGINT), 'a': 'I'}} AS u, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} AS a FROM turns
  UNION ALL
  SELECT conv_id, k, {", ".join(f"{closed[n]} AS {n}" for n in "syua")}
  FROM (SELECT w.conv_id, t.k, {", ".join(f"{ends[n]} AS {n}" for n in "syua")}
        FROM (SELECT conv_id, k, {names} FROM walk) w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1)),
done AS (SELECT conv_id, least(s, a) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
edits AS (
  SELECT conv_id, unnest(range(1, len(best.a) + 1)) AS i, best.a AS audit, len(replace(best.a, 'D', '')) AS n FROM done),
lines AS (
  SELECT e.conv_id, i, audit[i] AS edit, len(replace(audit[:i], 'I', '')) AS k, len(replace(audit[:i], 'D', '')) - n % 2 AS place FROM edits e),
mended AS (
  SELECT l.conv_id, string_agg(CASE WHEN edit = 'K' THEN t.role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY i) AS text
  FROM lines l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.k = l.k WHERE edit <> 'D' GROUP BY l.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT must AND open) AS truncated, count(*) FILTER (before IS NOT NULL AND before || class NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(m.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES = {"op11_structure_repair": op11_structure_repair}
ORACLES = {"op11_structure_repair": _sql()}
