from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tessera.llm.conversations import ORACLE_SQL, repair, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, `key` string, place string, alive int"
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    for conv, turn, role, text in rows:
        k = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(k.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All edits, each gap with up to two inserts: the least (cost, audit) whose roles fit, and its lines."""
    best = None
    choices = []
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        late = fault == "truncated"
        ways = [("D", 3, None)]
        if fault in ("none", "truncated"):
            ways += [("K", late, (role, text)), ("R", 2 + late, ("user", text)), ("R", 2 + late, ("assistant", text))]
        choices.append([((), 0), *(((g,), 2) for g in "ua"), (("u", "a"), 4), (("a", "u"), 4)])
        choices.append(ways)
    choices.append([((), 0), *(((g,), 2) for g in "ua"), (("u", "a"), 4), (("a", "u"), 4)])
    for picked in itertools.product(*choices):
        cost, audit, lines = 0, "", []
        for k, way in enumerate(picked):
            if k % 2 == 0:
                cost, audit = cost + way[1], audit + "I" * len(way[0])
                lines += [(FULL[g], "") for g in way[0]]
            else:
                cost, audit = cost + way[1], audit + way[0]
                lines += [way[2]] if way[2] else []
        if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(damage([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, text = cheapest(mine, found)
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No! ", "Half", "?", " \t", "", None, "Long\nanswer.\n", "Ünï…", "so.  \n"]
    rows = []
    for conv in [*range(n), None]:
        turn = rng.choice([0, 3, -2])
        for _ in range(rng.randrange(0, 4)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", 0) for r in rows], SCHEMA).repartition(3)


def repaired(spark, rows):
    return sorted((tuple(r) for r in repair_conversations(frame(spark, rows)).collect()), key=lambda r: (r[0] is None, r[0] or 0))


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(ORACLE_SQL).fetchall(), key=lambda r: (r[0] is None, r[0] or 0))


def test_equals_brute_force_and_sql(spark):
    rows = conversations(1, 150)
    got = repaired(spark, rows)
    assert got == brute(rows)
    assert got == sql(rows)


def test_long_and_empty(spark):
    rng = random.Random(2)
    rows = [(7, k, rng.choice(["system", "user", "assistant", "assistant"]), rng.choice(["a.", "b", "c?", f"{k}.", f"{k}", " "])) for k in range(400)]
    rows += [(8, 0, "user", "x" * 3_000_000), (8, 1, "assistant", "y." * 100)]
    got = repaired(spark, rows)
    assert got == sql(rows)
    assert repaired(spark, []) == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(conv, 0, "user", "Hi.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", empty)]


@pytest.mark.parametrize("letters,cost,audit", [("", 0, ""), ("ua", 0, "KK"), ("sua", 0, "KKK"), ("s", 3, "D"), ("u", 2, "KI"), ("a", 2, "IK"), ("uu", 2, "KR"), ("U", 3, "D"), ("-", 3, "D"), ("x", 3, "D"), ("uaUa", 1, "KKKK"), ("ua-ua", 3, "KKDKK"), ("au", 4, "IKKI")])
def test_worked_repairs(letters, cost, audit):
    assert repair(letters) == (cost, audit)


def test_many_turns_take_linear_time():
    cost, audit = repair("sua" + "ua" * 100_000 + "u")
    assert (cost, len(audit)) == (2, 200_005)
