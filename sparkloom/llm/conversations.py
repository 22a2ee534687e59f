"""Conversation structure repair: cheapest edits by a min-plus scan over turns.

Role initials must read ``(s?(ua)+)?``. The automaton of that pattern has four
states, so each turn is a 4x4 matrix of (cost, audit) elements, closed under
insertions; a conversation is the product of its turns. Products are
associative: long conversations are cut into segments whose products are made
apart and combined as a tree.

Elements of one cell always join strings for the same turns. Of equal cost,
none is a prefix of another (it would have more insertions, and cost more), so
the least string stays least whatever is appended: the products are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import lookup
from sparkloom.staging import materialize

#: Costs of the edits, and of leaving a truncated turn as it is.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A conversation of more turns, or bytes of text, is cut into segments of at most so many turns; products combined at a time.
LONG_TURNS, LONG_BYTES, FAN = 4096, 32 << 20, 16

#: State and role initial -> state; the start is 0, and 0 and 3 may end. Each state allows one of u and a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
_INK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]

# ---------------------------------------------------------------- matrices


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: costs add up, audits are joined, the least (cost, audit) stays."""
    out = []
    for row in a:
        cells: list[Element] = []
        for j in range(4):
            found = [(x[0] + y[0], x[1] + y[1]) for x, line in zip(row, b) if x and (y := line[j])]
            cells.append(min(found) if found else None)
        out.append(tuple(cells))
    return tuple(out)


def _matrix(edits: Iterable[tuple[int, int, int, str]]) -> Matrix:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for i, j, cost, name in edits:
        best[i, j] = min(best.get((i, j), (cost, name)), (cost, name))
    return tuple(tuple(best.get((i, j)) for j in range(4)) for i in range(4))


UNIT = _matrix((i, i, 0, "") for i in range(4))
_ONE = _matrix([*((i, i, 0, "") for i in range(4)), *((i, j, INSERT, "I") for (i, role), j in STEP.items() if role != "s")])
#: Any number of insertions: paths of the automaton longer than three only come back to a state.
CLOSURE = product(product(_ONE, _ONE), _ONE)


@lru_cache(maxsize=16)
def turn_matrix(kind: str) -> Matrix:
    """The edits of one turn, then insertions. ``kind`` is D for a turn that must go, else its role initial, in upper case if it is truncated."""
    edits = [(i, i, DELETE, "D") for i in range(4)]
    if kind != "D":
        more = TRUNCATED if kind.isupper() else 0
        edits += [(i, j, (0 if role == kind.lower() else REROLE) + more, "K" if role == kind.lower() else "R") for (i, role), j in STEP.items() if role == kind.lower() or role != "s"]
    return product(_matrix(edits), CLOSURE)


def product_of(matrices: list[Matrix]) -> Matrix:
    """The product in order, as a balanced tree."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else UNIT


def cheapest(whole: Matrix) -> tuple[int, str]:
    """Cost and audit of a conversation: from the start to a state that may end."""
    start = product(CLOSURE, whole)[0]
    return min(x for x in (start[0], start[3]) if x)


@lru_cache(maxsize=1 << 16)
def _solve(kinds: str) -> tuple[int, str]:
    return cheapest(product_of([turn_matrix(k) for k in kinds]))


def replay(audit: str, roles: Iterable[str], texts: Iterable[str], state: int = 0) -> tuple[list[str], int]:
    """The repaired turns as ``role:text``, and the state after them; insertions stand before the turn they precede."""
    turns, out = iter(zip(roles, texts)), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            initial = role[:1]
        else:
            initial = next(r for (i, r) in STEP if i == state and r != "s")
            role = ROLES[initial]
        state = STEP[state, initial]
        out.append(f"{role}:{text}")
    return out, state


def kind_of(role: str, fault: int) -> str:
    """See `turn_matrix`; ``fault`` is 0 for none, 1 blank, 2 duplicate, 3 truncated."""
    if fault in (1, 2):
        return "D"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == 3 else initial


def illegal_pairs(initials: str) -> int:
    """Neighbours other than su, ua and au."""
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def initials_of(roles: Iterable[str]) -> str:
    """First characters, with x for all that no pattern names, so that each turn has one."""
    return "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r in roles)


# ----------------------------------------------------------------- damage


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that the checksum of ``conv_id:turn`` chooses; null strings are one space.

    A dropped row stays with 0 copies, a repeated one has 2.
    """

    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), named(role_col).alias("role"), named(text_col).alias("text"), (F.crc32(F.concat(named(conv_col), F.lit(":"), named(turn_col)).cast("binary")) % 20).alias("case"))
    text = F.expr("CASE case WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END")
    return rows.select("conv_id", "turn", F.expr("CASE case WHEN 4 THEN 'user' ELSE role END").alias("role"), text.alias("text"), F.expr("CASE case WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END").alias("copies"))


def _own_fault() -> Column:
    """1 blank, 3 truncated, 0 none, from the text alone."""
    return F.when(~F.col("text").rlike(_INK), 1).when(~F.col("text").rlike(_ENDED), 3).otherwise(0)


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

# ------------------------------------------------------ short conversations


def _repair_short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> one row per conversation; at most one conversation is held."""
    name, conv, rows, out = None, None, [], []

    def one() -> tuple:
        seen, faults = set(), []
        for _, role, text, own in rows:
            faults.append(1 if own == 1 else 2 if (role, text) in seen else own)
            seen.add((role, text))
        roles, texts = [r[1] for r in rows], [r[2] for r in rows]
        kinds = "".join(map(kind_of, roles, faults))
        cost, audit = _solve(kinds) if len(kinds) <= 64 else cheapest(product_of([turn_matrix(k) for k in kinds]))
        lines, _ = replay(audit, roles, texts)
        known = {r[0] for r in rows if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        return (conv, gaps, *(faults.count(i) for i in (1, 2, 3)), illegal_pairs(initials_of(roles)), cost, audit, digest)

    for b in batches:
        for key, conv_id, turn, role, text, copies, own in zip(*(c.to_pylist() for c in b.columns)):
            if name is not None and key != name:
                out.append(one())
                rows = []
            name, conv = key, conv_id
            rows += [(turn, role, text, own)] * copies
        if out:
            yield _batch(out, b.schema.field(1).type)
            out = []
    if name is not None:
        yield _batch([one()], b.schema.field(1).type)


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", *(c.split()[0] for c in _RESULT.split(", "))])


# ------------------------------------------------------- long conversations

_CELLS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_PRODUCT = "key string, part long, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, cells array<struct<cost:long,audit:string>>"


def _pack(key: str, part: int, sums: list[int], head: str, tail: str, m: Matrix) -> pa.Table:
    cells = [None if x is None else {"cost": x[0], "audit": x[1]} for row in m for x in row]
    values = [key, part, *sums, head, tail, cells]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), _CELLS]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _PRODUCT.split(", ")])


def _unpack(cells: list) -> Matrix:
    flat = [None if x is None else (x["cost"], x["audit"]) for x in cells]
    return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))


def _expand(t: pa.Table) -> list[tuple[str, str, int]]:
    """Rows in order as (role, text, fault), each copy by itself: of equal rows only the first can be no duplicate."""
    out = []
    for role, text, own, n, first in zip(*(t[c].to_pylist() for c in ("role", "text", "own", "n", "first"))):
        again = 1 if own == 1 else 2
        out += [(role, text, own if first else again)] + [(role, text, again)] * (n - 1)
    return out


def _segment_product(key: tuple, t: pa.Table) -> pa.Table:
    rows = _expand(t.sort_by("at"))
    initials = initials_of(r for r, _, _ in rows)
    faults = [f for *_, f in rows]
    m = product_of([turn_matrix(kind_of(r, f)) for r, _, f in rows])
    return _pack(key[0].as_py(), key[1].as_py(), [len(rows), *(faults.count(i) for i in (1, 2, 3)), illegal_pairs(initials)], initials[:1], initials[-1:], m)


def _combine(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("part")
    sums = [sum(t[c].to_pylist()) for c in ("n", "blank", "duplicate", "truncated", "illegal")]
    heads, tails = t["head"].to_pylist(), t["tail"].to_pylist()
    sums[-1] += sum(illegal_pairs(a + b) for a, b in zip(tails, heads[1:]))
    return _pack(key[0].as_py(), key[1].as_py(), sums, heads[0], tails[-1], product_of([_unpack(c) for c in t["cells"].to_pylist()]))


def tree_level(parts: DataFrame, group: Column) -> DataFrame:
    """One level of the tree: neighbours with the same ``group`` become one product."""
    return parts.withColumn("group", group).groupBy("key", "group").applyInArrow(_combine, _PRODUCT)


def _slices(key: tuple, whole: pa.Table, segments: pa.Table) -> pa.Table:
    """The part of an audit, and the state before it, of each segment; insertions go with the turn they precede, the last ones with the last segment."""
    audit = whole["audit"][0].as_py()
    system_first = (len(audit) - audit.count("D")) % 2 > 0  # turns come in pairs but for a first one that is kept
    segments = segments.sort_by("part")
    at, state, cut, states = 0, 0, [], []
    for i, n in enumerate(segments["n"].to_pylist()):
        begin, left = at, n
        while left:
            left -= audit[at] != "I"
            at += 1
        at = len(audit) if i + 1 == len(segments) else at
        cut.append(audit[begin:at])
        states.append(state)
        for edit in cut[-1]:
            if edit != "D":
                state = 1 if state == 0 and system_first else {0: 2, 1: 2, 2: 3, 3: 2}[state]
    return pa.table({"key": [key[0].as_py()] * len(cut), "part": segments["part"], "audit": cut, "state": pa.array(states, pa.int32())})


def _repaired_segment(key: tuple, t: pa.Table, cut: pa.Table) -> pa.Table:
    rows = _expand(t.sort_by("at"))
    state, audit = cut["state"][0].as_py(), cut["audit"][0].as_py()
    lines, _ = replay(audit, (r for r, _, _ in rows), (x for _, x, _ in rows), state)
    return pa.table({"key": [key[0].as_py()], "part": [key[1].as_py()], "text": pa.array(["\n".join(lines) if lines else None], pa.string())})


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation and order -> digests; one segment is held at a time."""
    name, state, empty = None, hashlib.sha256(), True

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], names=["key", "repaired_sha256"])

    for b in batches:
        for key, text in zip(b.column(0), b.column(2)):
            if key.as_py() != name:
                if name is not None:
                    yield out()
                name, state, empty = key.as_py(), hashlib.sha256(), True
            if text.is_valid:
                state.update((b"" if empty else b"\n") + text.as_py().encode())
                empty = False
    if name is not None:
        yield out()


def _ordered(batches: Iterable[pa.RecordBatch], turns: int) -> Iterator[pa.RecordBatch]:
    """Adds the segment: the partition, and a number that rises when a conversation ends or a segment is full."""
    pid = TaskContext.get().partitionId()
    name, held, number, at = None, 0, 0, 0
    for b in batches:
        part, place = [], []
        for key, n in zip(b.column(0).to_pylist(), b.column(5).to_pylist()):
            if key != name or held + n > turns:
                name, held, number = key, 0, number + 1
            held += n
            at += 1
            part.append((pid << 32) + number)
            place.append(at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int64()), pa.array(place, pa.int64())], names=[*b.schema.names, "part", "at"])


def _repair_long(rows: DataFrame, turns: int) -> DataFrame:
    """key and the results for long conversations; ``rows`` has key, turn, role, text, copies and own."""
    rows = rows.where("copies > 0").withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    runs = rows.groupBy("key", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.max("text").alias("text"), F.max("own").alias("own"))
    runs = materialize(runs, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = materialize(runs.groupBy("key", "digest").agg(F.min(order).alias("least")), "first-turns")
    runs = lookup(runs, first, ["key", "digest"], row_bytes=128).withColumn("first", F.col("turn").eqNullSafe(F.col("least.turn")))
    runs = runs.select("key", "turn", "role", "text", "own", "n", "first", "digest").repartitionByRange("key", "turn", "role", "digest").sortWithinPartitions("key", "turn", "role", "digest")
    ordered = materialize(runs.mapInArrow(lambda b: _ordered(b, turns), "key string, turn long, role string, text string, own int, n long, first boolean, digest string, part long, at long"), "ordered-turns")

    segments = materialize(ordered.groupBy("key", "part").applyInArrow(_segment_product, _PRODUCT), "segments")
    tree = materialize(tree_level(segments, F.shiftright("part", 32)), "segments")
    while tree.groupBy("key").count().where("count > 1").limit(1).count():
        tree = materialize(tree_level(tree, F.floor(F.col("part") / FAN).cast("long")), "segments")

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cheapest(_unpack(c)) for c in b.column(b.schema.get_field_index("cells")).to_pylist()]
            same = [b.column(b.schema.get_field_index(c)) for c in ("key", "blank", "duplicate", "truncated", "illegal")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    solved = materialize(tree.mapInArrow(best, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")
    # an audit is one cell of the result, so a task holds it anyway
    cut = solved.select("key", "audit").groupBy("key").cogroup(segments.select("key", "part", "n").groupBy("key")).applyInArrow(_slices, "key string, part long, audit string, state int")
    texts = ordered.groupBy("key", "part").cogroup(cut.groupBy("key", "part")).applyInArrow(_repaired_segment, "key string, part long, text string")
    # a digest reads its bytes one after the other: they pass through a task, which holds one segment
    digests = texts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_digest, "key string, repaired_sha256 string")
    gaps = rows.where("turn IS NOT NULL").groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    return solved.join(digests, "key").join(gaps, "key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))


# -------------------------------------------------------------------- all


def repair(turns: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Per conversation the faults, the cheapest edits and the digest of the repaired turns, for ``turns`` of `damaged`.

    Rows are ordered by turn (nulls first), then role and text; equal rows are
    copies, all but the first of which are duplicates. Null conversation ids
    are one conversation. One without rows after the damage has zeros, an
    empty audit and the digest of no bytes. Roles with other initials can only
    be changed or deleted. Other columns are ignored; an empty table gives no
    rows. Conversations of up to ``long_turns`` turns and ``long_bytes`` bytes
    are repaired by one pass over sorted rows, longer ones by segments.
    """
    rows = turns.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))).withColumn("own", _own_fault().cast("int"))
    sizes = rows.groupBy("key").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"), F.max("conv_id").alias("conv_id"))
    long = materialize(sizes.where((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)).select("key", "conv_id"), "long-conversations")
    some = not long.isEmpty()
    short = lookup(rows, long.select("key"), "key", "left_anti") if some else rows
    kind = turns.schema["conv_id"].dataType.simpleString()
    short = short.select("key", "conv_id", "turn", "role", "text", "copies", "own").repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    out = short.mapInArrow(_repair_short, f"conv_id {kind}, {_RESULT}")
    if some:
        found = _repair_long(lookup(rows, long.select("key"), "key", "left_semi"), long_turns)
        out = out.unionByName(found.join(long, "key").select(*out.columns))
    return out
