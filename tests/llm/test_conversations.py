"""Conversation repair against a plain search over edits, and fragments of long conversations."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from panelmill.llm import conversations as C
from panelmill.llm import registry

#: Which initials may follow which in (s?(ua)+)?.
FOLLOWS = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
ROWS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, edits, repaired) of rows (initial, fault, role, text) by a search for whole strings of edits."""

    @functools.cache
    def best(i, last, inserts):
        """Behind i rows and the repaired role last; strings are whole, so the least one is exact."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in FOLLOWS[last]:
                    cost, edits, lines = best(i, role[0], inserts + 1)
                    found.append((cost + 3, "I" + edits, (f"{role}:", *lines)))
        if i < len(rows):
            initial, fault, role, text = rows[i]
            cost, edits, lines = best(i + 1, last, 0)
            found.append((cost + 4, "D" + edits, lines))
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                for letter, own, base in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    to = own[:1]
                    if to and to in FOLLOWS[last]:
                        cost, edits, lines = best(i + 1, to, 0)
                        found.append((cost + base + extra, letter + edits, (f"{own}:{text}", *lines)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def brute(turns):
    """All digest columns from plain rows (conv_id, turn, role, text)."""
    out = {}
    for key in {t[0] for t in turns}:
        rows = []
        for conv, turn, role, text in turns:
            if conv != key:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, counts = set(), [], [0, 0, 0, 0]
        for _, role, text in rows:
            body = text.rstrip(" \t\n\v\f\r")
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role[:1], fault, role, text))
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, lines = cheapest(tuple(judged))
        out[key] = (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def random_turns(rng, conversations, longest):
    out = []
    for key in range(conversations):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Fine.", "Cut", "", " \n", "Why?", "Yes! ", None, f"No {rng.random()}."])
            out.append((key, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_a_search(spark, seed):
    turns = random_turns(random.Random(seed), 40, 6)
    # Equal numbers are ordered by a digest; keep one row a number so that both orders agree.
    turns = list({(t[0], t[1]): t for t in turns}.values())
    assert digests(C.repair_digests(spark.createDataFrame(turns, ROWS))) == brute(turns)


def test_long_conversations_lie_in_several_fragments(spark, request):
    rng = random.Random(7)
    turns = [(5, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One.", "two", f"Three {i}.", f"four {i}"])) for i in range(90)]
    turns += [(6, i, "user", f"Only {i}.") for i in range(60)] + [(None, i, "assistant", f"None {i}") for i in range(40)]
    df = spark.createDataFrame(turns, ROWS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    parts = C.plan_repair(C.damaged(df)).selectExpr("conv_id", "place >> 33 AS part").distinct().groupBy("conv_id").count()
    assert parts.where("count > 1").count() >= 1
    assert digests(C.repair_digests(df)) == brute(turns)


def test_runs_equal_single_steps():
    rng = random.Random(3)
    for _ in range(60):
        symbols = [s for _ in range(rng.randint(1, 6)) for s in [rng.randint(0, 8)] * rng.randint(1, 90)]
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        costs = C.END
        for s in reversed(symbols):
            costs = C.product(C.power(s, 0), costs)
        whole = C.END
        for s, n in reversed(runs):
            whole = C.advance(s, n, whole)
        assert (costs == whole).all()
        edits, state = C.unroll_runs(runs, 0, C.END)
        single, at = [], 0
        behind = [C.END]
        for s in reversed(symbols[1:]):
            behind.append(C.product(C.power(s, 0), behind[-1]))
        for s, after in zip(symbols, reversed(behind), strict=True):
            at = C.unroll(s, 1, at, after, single)
        assert edits == single and state == at
        text = "".join(edits) + C.closing(state)
        left = sum({"D": 4, "I": 3, "R": 3, "K": 0}[k] for k in text) + sum(3 for s, e in zip(symbols, edits, strict=True) if 4 <= s < 8 and e[-1] != "D")
        assert left == costs[0]


def test_choices_are_the_least_strings():
    for symbols in itertools.product(range(9), repeat=3):
        rows = tuple(("suax"[s % 4] if s < 8 else "u", 3 if 4 <= s < 8 else 2 if s == 8 else 0, "suax"[s % 4] if s < 8 else "u", "t") for s in symbols)
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        edits, state = C.unroll_runs(runs, 0, C.END)
        cost, audit, _ = cheapest(rows)
        behind = np.array(C.END)
        for s, n in reversed(runs):
            behind = C.advance(s, n, behind)
        assert ("".join(edits) + C.closing(state), behind[0]) == (audit, cost)


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.01"
    got = registry.op11_conversations(spark, path).toPandas().sort_values("conv_id").reset_index(drop=True)
    duckdb.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = duckdb.sql(registry.OP11_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and len(got) == len(want) >= 100
    for c in got.columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_awkward_conversations(spark):
    turns = [(1, None, None, None), (2, 0, "user", "x" * 200_000 + "."), (None, 3, "user", "Hm."), (None, 4, "assistant", "Hm."), (3, 1, "", ""), (3, -5, "uniform", "Odd initial.")]
    turns += [(9, 0, "user", "Same.")] * 50
    df = spark.createDataFrame([(*t, "clash", 7, 1, True, "e") for t in turns], ROWS + ", place string, k1 int, copies int, opening boolean, edits string")
    got = digests(C.repair_digests(df))
    assert got == brute(turns) and set(got) == {1, 2, 3, 9, None}
    empty = C.repair_digests(df.limit(0))
    assert empty.count() == 0 and empty.columns == [f.split()[0] for f in C.DIGEST.split(", ")]


def test_dropped_conversations_stay(spark):
    key = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = digests(C.repair_digests(spark.createDataFrame([(key, 0, "user", "Gone.")], ROWS)))
    assert got == {key: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows_carry_their_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "assistant", " ")], ROWS).selectExpr("*", "1L AS copies")
    rows = {r["turn"]: (r["edits"], r["role"], r["text"]) for r in C.repair(df).collect()}
    assert rows == {0: ("K", "user", "Hello."), 1: ("R", "user", "Again."), 2: ("D", None, None)}
