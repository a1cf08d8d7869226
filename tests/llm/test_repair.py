import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tidemark.llm import repair

ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "And"), (1, 4, "assistant", "No! "), (1, 5, "assistant", "No! "), (1, 6, "user", " \t"),
    (2, None, None, None), (2, None, "user", "x"), (2, 3, "system", "s."), (3, 0, "system", "A."), (4, 0, "tool", "?"), (4, 0, "", "."), (4, 1, "User", "a."),
    (None, 0, "user", "Null id."), (None, 1, "assistant", "Long " * 5000), (5, -(2**62), "user", "é😀!"), (5, 2**63 - 1, "assistant", "Late?"), (6, 1, "user", "same."), (6, 2, "user", "same."),
    *((7, k, ("user", "assistant")[k * 7 % 5 % 2], f"t{k % 37}.") for k in range(2500)),
]


@pytest.fixture(scope="module")
def talk(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(1) for c in ("pos", "sign", "audit", "cost", "gaps", "span")})


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            yield from [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def brute(rows, most=None):
    """From left to right over the automaton of `(s?(ua)+)?`; every insertion before every row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, marks = set(), []
    for _, _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        marks.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    # the state: initials so far, cut to what matters: nothing, s, u or a last
    state = {"": (0, "", ())}

    def put(to, at, value):
        if to not in ("", "s", "u", "a"):
            return
        if at not in state or value[:2] < state[at][:2]:
            state[at] = value

    def leads(a, c):
        return c if (a, c) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

    def inserts():
        for _ in range(3):
            for a, (cost, audit, out) in list(state.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if leads(a, c):
                        put(c, c, (cost + 3, audit + "I", (*out, f"{role}:")))

    inserts()
    for (_, _, role, text), mark in zip(rows, marks):
        old, cut = dict(state), 3 * (mark == "truncated")
        state.clear()
        for a, (cost, audit, out) in old.items():
            put(a, a, (cost + 4, audit + "D", out))
            if mark in ("blank", "duplicate"):
                continue
            if role and leads(a, role[0]):
                put(role[0], role[0], (cost + cut, audit + "K", (*out, f"{role}:{text}")))
            for c, name in (("u", "user"), ("a", "assistant")):
                if leads(a, c):
                    put(c, c, (cost + 3 + cut, audit + "R", (*out, f"{name}:{text}")))
        inserts()
    cost, audit, out = min((v for k, v in state.items() if k in ("", "a")), key=lambda v: v[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (
        gaps if gaps < 2**63 else None, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_brute_force(spark, talk):
    hurt = list(damage(ROWS))
    want = {c: brute([r for r in hurt if r[0] == c]) for c in {r[0] for r in ROWS}}
    assert found(repair.repair(repair.damaged(talk), talk)) == want
    assert found(repair.repair(talk)) == {c: brute([(a, t, r or " ", x or " ") for a, t, r, x in ROWS if a == c] if c != 4 else [r for r in ROWS if r[0] == 4]) for c in want}


def full_chart(signs):
    """Plain CYK over all spans and all splits."""
    cells = {(k, k + 1): repair.leaf(c) for k, c in enumerate(signs)}
    for length in range(2, len(signs) + 1):
        for i in range(len(signs) - length + 1):
            cell = {}
            for m in range(i + 1, i + length):
                for k, v in repair.joined(cells[i, m], cells[m, i + length]).items():
                    cell[k] = min(cell.get(k, v), v)
            cells[i, i + length] = cell
    return cells[0, len(signs)]


def test_one_split_a_span_is_enough():
    rng = random.Random(5)
    short = ["".join(x) for n in (1, 2, 3) for x in itertools.product("sSuUaAxX02", repeat=n)]
    for signs in [*short, *("".join(rng.choice("sSuUaAxX0123") for _ in range(rng.randint(4, 14))) for _ in range(150))]:
        assert repair.parsed(signs) == full_chart(signs)


def test_rows(spark, talk):
    rows = {}
    for r in sorted(repair.repaired(talk).collect(), key=lambda r: r["place"]):
        rows.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, hashes in found(repair.repair(talk)).items():
        assert hashlib.sha256("\n".join(rows.get(conv, [])).encode()).hexdigest() == hashes[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in rows.get(conv, [])))


def test_sql(spark, small, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    rel = con.sql(repair.ORACLES["op11_structure_repair"])
    want = {r[0]: tuple(r[rel.columns.index(n)] for n in NAMES) for r in rel.fetchall()}
    assert found(repair.op11_structure_repair(spark, small)) == want


def test_empty(spark, talk):
    assert repair.repair(talk.limit(0), talk.limit(0)).count() == 0
    gone = found(repair.repair(talk.limit(0), talk))
    assert gone[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and None in gone
