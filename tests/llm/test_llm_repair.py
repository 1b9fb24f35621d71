"""Repair of conversations against an exhaustive search, with and without spilling."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from beaconry.llm import repair

ROWS = "conv_id long, turn int, role string, text string, digest string, fault int, lost boolean"
SPACE = " \t\n\x0b\f\r"


def damaged_plain(rows):
    out, ids = {}, []
    for conv, turn, role, text in rows:
        ids.append(conv)
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: sorted(out.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c in ids}


def cheapest(rows, faults):
    """All edit strings by uniform cost, without any dynamic program: breadth first over (cost, audit)."""
    heap, best = [(0, "", 0, "", ())], None
    import heapq
    while heap:
        cost, audit, k, initials, said = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, said)
        if not re.fullmatch(r"(s?(ua)*u?)?", initials):
            continue
        for role in ("user", "assistant"):
            if not audit.endswith("II"):
                heapq.heappush(heap, (cost + 3, audit + "I", k, initials + role[0], said + ((role, ""),)))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, initials, said))
            if faults[k] not in ("blank", "duplicate"):
                fix = 3 * (faults[k] == "truncated")
                if role:
                    heapq.heappush(heap, (cost + fix, audit + "K", k + 1, initials + role[0], said + ((role, text),)))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + fix, audit + "R", k + 1, initials + other[0], said + ((other, text),)))
    return best


def plain(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, said = cheapest(rows, faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def fixture():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "tool", "uncle", ""], ["Yes.", "No!", "Cut", "Why? ", "", None, " \n", "Yes."]
    rows = []
    for conv in [*range(150), None]:
        rows += [(conv, rng.choice([t, t, t, rng.randrange(6), None]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(1, 5))]
    return rows


@pytest.mark.parametrize("buffer_bytes", [1 << 20, 1])
def test_equals_exhaustive_search(spark, buffer_bytes):
    rows = fixture()
    frame = spark.createDataFrame([(*r, "x", 9, None) for r in rows], ROWS).repartition(3)
    report, turns = repair.repaired(repair.damaged(frame), True, buffer_bytes)
    got = {r.conv_id: tuple(r)[1:] for r in report.select(*repair.REPORT, "audit", "repaired_sha256").collect()}
    want = {c: plain(found) for c, found in damaged_plain(rows).items()}
    assert got == want
    said = {}
    for r in sorted(turns.collect(), key=lambda r: r.part):
        said.setdefault(r.conv_id, []).extend(r.turns or [])
    assert {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in v).encode()).hexdigest() for c, v in said.items()} == {c: w[-1] for c, w in want.items()}


def test_long_conversation_and_empty_table(spark):
    frame = spark.range(5_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    report, _ = repair.repaired(frame, buffer_bytes=20_000)
    row = report.collect()
    assert len(row) == 1 and row[0].audit == "K" * 5_000 and row[0].cost == row[0].illegal == row[0].duplicate == 0
    said = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:{k}." for k in range(5_000))
    assert row[0].repaired_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert repair.repaired(frame.limit(0))[0].collect() == []


def test_ties_take_the_least_letters():
    for kinds in product(["user", "assistant", "system", "tool"], repeat=4):
        rows = [(k, role, "Yes.") for k, role in enumerate(kinds)]
        state, cost, back = repair.START, 0, b""
        for _, role, _ in rows:
            state, paid, way = repair.step(state, role[0], repair.SOUND)
            cost, back = cost + paid, back + way
        more, place, inserts = repair.ending(state)
        editor = repair.Editor(True)
        editor.apply(repair.edits_of(back, place)[0], list(kinds), ["Yes."] * 4)
        editor.insert(inserts)
        assert (cost + more, "".join(editor.audit), tuple(editor.turns)) == cheapest(rows, [""] * 4)
