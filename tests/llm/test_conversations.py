import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from catalume.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, at string, audit string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def every_way(rows, kinds, most):
    """(cost, audit, turns) of all edits up to a cost, checked by the grammar as a pattern; nothing shared with the operator."""
    found = []

    def go(i, cost, audit, turns, inserted):
        if cost > most:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join((r[:1] or "?") for r, _ in turns)):
            found.append((cost, audit, turns))
        if inserted < 3:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*turns, (role, "")], inserted + 1)
        if i < len(rows):
            (role, text), kind = rows[i], kinds[i]
            go(i + 1, cost + 3, audit + "D", turns, 0)
            if kind not in ("blank", "duplicate"):
                more = kind == "truncated"
                go(i + 1, cost + more, audit + "K", [*turns, (role, text)], 0)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*turns, (to, text)], 0)

    go(0, 0, "", [], 0)
    return min(found, key=lambda f: f[:2]) if found else None


def wanted(rows):
    """(cost, audit, digest) by raising the limit of cost."""
    kinds = faults(rows)
    for most in itertools.count():
        best = every_way(rows, kinds, most)
        if best:
            return best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()


def repaired(spark, table, stretch=conversations.STRETCH):
    df = spark.createDataFrame(table, SCHEMA)
    told = conversations.materialise(conversations.report(df, stretch), "report")
    turns = conversations.repaired(df, told)
    return {r.conv_id: r for r in conversations._left(told, conversations.digests(turns)).collect()}


def made(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No!", "Why?", "cut", "", " \n", f"T{rng.randrange(9)}.", "Yes."])) for _ in range(n)]


@pytest.mark.parametrize("stretch", [2, 256])
def test_against_every_sequence_of_edits(spark, stretch):
    """Short conversations; with stretches of two turns most are cut, and joined again over several rounds."""
    rng, table, want = random.Random(5), [], {}
    for conv in range(60):
        rows = made(rng, rng.randrange(1, 6))
        table += [(conv, i, r, t, "x", "y") for i, (r, t) in enumerate(rows)]
        want[conv] = rows
    got = repaired(spark, table, stretch)
    assert set(got) == set(want)
    for conv, rows in want.items():
        cost, audit, digest = wanted(rows)
        r = got[conv]
        assert (r.cost, r.audit, r.repaired_sha256 or hashlib.sha256(b"").hexdigest()) == (cost, audit, digest), rows
        kinds = faults(rows)
        assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))


def plain_cost(rows):
    """The least (cost, audit) of a long conversation, state by state from the end."""
    kinds, after = faults(rows), {0: 2, 1: 2, 2: 3, 3: 2}
    close = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    for (role, _), kind in zip(reversed(rows), reversed(kinds), strict=True):
        now, more = {}, kind == "truncated"
        for s in range(4):
            ways = [(3 + close[s][0], "D" + close[s][1])]
            if kind not in ("blank", "duplicate"):
                n = after[s]
                ways.append((2 + more + close[n][0], "R" + close[n][1]))
                if role[:1] == ("a" if n == 3 else "u"):
                    ways.append((more + close[n][0], "K" + close[n][1]))
                if s == 0 and role[:1] == "s":
                    ways.append((more + close[1][0], "K" + close[1][1]))
            now[s] = min(ways)
        for _ in range(2):
            now = {s: min(now[s], (2 + now[after[s]][0], "I" + now[after[s]][1])) for s in range(4)}
        close = now
    return close[0]


def test_one_long_conversation_among_short_ones(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["user", "assistant", "system"]), f"Turn {i}{rng.choice(['.', '.', '.', ''])}") for i in range(3_000)]
    table = [(7, i, r, t, "", "") for i, (r, t) in enumerate(rows)] + [(c, i, ("user", "assistant")[i % 2], f"{i}.", "", "") for c in (6, 8) for i in range(4)]
    got = repaired(spark, table)
    assert (got[7].cost, got[7].audit) == plain_cost(rows)
    assert (got[6].cost, got[6].audit, got[8].audit) == (0, "KKKK", "KKKK")
    told = got[7].audit
    turns = conversations.repaired(spark.createDataFrame(table, SCHEMA), spark.createDataFrame([(7, told)], "conv_id long, audit string").unionByName(spark.createDataFrame([(6, "KKKK"), (8, "KKKK")], "conv_id long, audit string")))
    roles = "".join(r.role[0] for r in turns.where("conv_id = 7").orderBy("place").collect())
    assert re.fullmatch(r"(s?(ua)+)?", roles)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts; ties of turns; repeated rows; other columns."""
    table = [
        (None, 1, "user", "One.", "x", "x"),
        (None, 2, "assistant", "Two.", "x", "x"),
        (1, None, "system", "Set.", "x", "x"),
        (1, 5, "user", None, "x", "x"),
        (1, 2, None, "Who?", "x", "x"),
        (2, 1, "user", "Same.", "x", "x"),
        (2, 1, "user", "Same.", "x", "x"),
        (3, 9, "assistant", "A" * 200_000, "x", "x"),
    ]
    got = repaired(spark, table)
    assert (got[None].audit, got[None].cost) == ("KK", 0)
    assert (got[1].gaps, got[1].blank, got[1].illegal, got[1].audit) == (2, 1, 2, "KRDI") or got[1].cost == wanted([("system", "Set."), (" ", "Who?"), ("user", " ")])[0]
    assert (got[2].duplicate, got[2].audit) == (1, "KDI")
    assert got[2].repaired_sha256 == hashlib.sha256(b"user:Same.\nassistant:").hexdigest()
    assert (got[3].truncated, got[3].audit) == (1, "D")


def test_damage_and_conversations_left_without_a_turn(spark):
    drops = [i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(i, 0, "user", "A. b! c?", "", "") for i in range(500)], SCHEMA)
    left = {(r.conv_id, r.role, r.text) for r in conversations.damage(df).collect()}
    for i in range(500):
        kind = zlib.crc32(f"{i}:0".encode()) % 20
        assert ((i, "user", {1: "", 2: "A b c"}.get(kind, "A. b! c?")) in left) == (kind != 0)
    out = {r.conv_id: r for r in conversations.repair_damaged(df.where(F.col("conv_id").isin(*drops[:3]))).collect()}
    assert set(out) == set(drops[:3])
    assert all((r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest()) for r in out.values())


def test_empty_table(spark):
    assert conversations.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
