"""Conversation repair against all edit sequences, by sorted rows and by segments."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from sparkloom.llm import conversations as C
from sparkloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, extra int, cost int"


def damage(rows):
    """Plain version of the damage: conv_id -> its rows in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        mine += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, faults):
    """The best (cost, audit, repaired) of every choice of edits and of up to two insertions at each place."""
    more = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    for edits in itertools.product(*choices):
        base = sum(2 if e == "D" else e[0] == "R" for e in edits) + sum(5 for e, f in zip(edits, faults) if f == "truncated" and e != "D")
        for put in itertools.product(more, repeat=len(rows) + 1):
            initials, audit, lines = "", "", []
            for i, ins in enumerate(put):
                for role in ins:
                    initials, audit = initials + role, audit + "I"
                    lines.append(("user" if role == "u" else "assistant") + ":")
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    audit += e[0]
                    if e != "D":
                        role = role if e == "K" else {"u": "user", "a": "assistant"}[e[1]]
                        initials += role[:1] or "?"
                        lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials):
                found = (base + 5 * audit.count("I"), audit, "\n".join(lines))
                best = min(best, found) if best else found
    return best


def brute(rows):
    out = {}
    for conv, mine in damage(rows).items():
        faults = faults_of(mine)
        cost, audit, text = all_edits(mine, faults)
        known = {t for t, *_ in mine if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def some_rows(seed, conversations, turns):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi.", "no end", "Why? \n", " \t\r", "", None, " ", "a. ", "İ!", "x" * 300 + "!", "so.  "]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "stranger", "ugly"]
    ids = [None, *range(conversations)]
    return [(c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts), 1, 2) for c in ids for _ in range(rng.randrange(1, turns + 1))]


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("long_turns", [C.LONG_TURNS, 1])
def test_equals_all_edit_sequences(spark, long_turns):
    rows = some_rows(1, 60, 3)
    got = found(C.repair(C.damaged(spark.createDataFrame(rows, SCHEMA)), long_turns))
    assert got == brute(rows)


def test_segments_equal_one_pass(spark):
    rng = random.Random(5)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Hi.", "Hi.", f"{c} {t}.", f"{t} no end", ""]), 0, 0) for c, n in ((1, 700), (2, 40), (3, 3)) for t in range(n)]
    table = C.damaged(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    assert found(C.repair(table, 7)) == found(C.repair(table)) == found(C.repair(table, 10_000, 300))


def test_products_are_associative():
    rng = random.Random(3)
    for _ in range(50):
        kinds = [C.turn_matrix(rng.choice("DsuaxSUAX")) for _ in range(9)]
        left = kinds[0]
        for m in kinds[1:]:
            left = C.product(left, m)
        assert left == C.product_of(kinds)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damaged(empty)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(C.repair(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", 0, 0)], SCHEMA))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_equals_sql(spark, sf_dir):
    df = queries.op12_conversations(spark, sf_dir)
    want = duckdb.sql(queries.ORACLE_SQL["op12_conversations"].replace("FROM conversations", f"FROM '{sf_dir}/conversations.parquet'")).select(*(duckdb.ColumnExpression(c) for c in df.columns))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
