"""Conversation repair: block tables against a search over all edits, and whole tables against plain Python."""

import hashlib
import re
import zlib
from itertools import product

import pytest

from washkit.llm import turn_repair as T
from washkit.llm.queries import op12_turn_repair

FITS = re.compile(r"(s?(ua)+)?\Z")


def search(symbols, most):
    """(cost, audit) by trying out all edits that cost at most ``most``."""
    best = None
    todo = [(0, "", "", 0)]  # cost, audit, roles, rows used
    while todo:
        cost, audit, roles, i = todo.pop()
        if cost > most or not re.match(r"s?(ua)*u?\Z", roles):
            continue
        if i == len(symbols) and FITS.match(roles):
            best = min(best or (cost, audit), (cost, audit))
        for r in "ua":
            todo.append((cost + 5, audit + "I", roles + r, i))
        if i < len(symbols):
            s = symbols[i]
            todo.append((cost + 2, audit + "D", roles, i + 1))
            if s < 8:
                more = 5 * (s >= 4)
                todo.append((cost + more, audit + "K", roles + "sua?"[s % 4], i + 1))
                for r in "ua":
                    todo.append((cost + 1 + more, audit + "R", roles + r, i + 1))
    return best


def plain(symbols):
    """(cost, audit) by a table over rows and states, strings compared whole."""
    to = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    after = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    for s in reversed(symbols):
        now = {}
        for q in range(4):
            found = [(2 + after[q][0], "D" + after[q][1])]
            if s < 8:
                more = 5 * (s >= 4)
                c, a = after[to[q][1]]
                found.append((1 + more + c, "R" + a))
                if (q, s % 4) in {(0, 0), (0, 1), (1, 1), (2, 2), (3, 1)}:
                    c, a = after[{0: 1, 1: 2, 2: 3}[s % 4]]
                    found.append((more + c, "K" + a))
            now[q] = min(found)
        for _ in range(4):
            now = {q: min(now[q], (5 + now[to[q][1]][0], "I" + now[to[q][1]][1])) for q in range(4)}
        after = now
    return after[0]


def test_short_conversations_against_all_edits():
    tables = T.Tables()
    for n in range(4):
        for symbols in product(range(9), repeat=n):
            cost, audit = tables.solve(bytes(symbols))
            assert (cost, audit) == plain(symbols)
            if n < 3:
                assert (cost, audit) == search(symbols, 2 * n)


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_long_conversations_against_the_plain_table(block):
    tables = T.Tables(block)
    for seed in range(60):
        x, symbols = seed + 1, []
        for _ in range(seed * 7 % 97):
            x = x * 1103515245 + 12345 & 0x7FFFFFFF
            symbols.append((x >> 16) % 9 if seed % 3 else [0, 1, 2, 1, 2][(x >> 16) % 5])
        assert tables.solve(bytes(symbols)) == plain(symbols)


def test_table_bounds():
    tables = T.Tables()
    assert len(tables.vectors) < 200 and tables.step_blocks.shape == (len(tables.vectors), 10 ** T.BLOCK)
    cost, audit = tables.solve(bytes([1, 2] * 100000))
    assert cost == 0 and audit == "K" * 200000


WHITE = " \t\n\v\f\r"


def expected(rows):
    """Report of (conv_id, turn, role, text) rows after damage, by plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv and r[4]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text, _ in own:
            t = text.strip(WHITE)
            fault = 1 if not t else 2 if (role, text) in seen else 3 if t[-1] not in ".!?" else 0
            seen.add((role, text))
            if fault:
                counts[fault - 1] += 1
            symbols.append(8 if fault in (1, 2) else {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * (fault == 3))
        cost, audit = plain(symbols)
        turns = {r[0] for r in own} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        made, i, state = [], 0, 0
        for e in audit:
            if e == "I":
                made.append(("assistant" if state == 2 else "user") + ":")
                state = 3 if state == 2 else 2
                continue
            role, text = own[i][1:3]
            i += 1
            if e == "D":
                continue
            if e == "R":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            made.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def reported(df):
    names = (*T.COUNTS, "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in T.report(df).collect()}


ROWS = [
    (1, 0, "user", "Hi?"), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "A."), (2, 1, "user", "B."), (2, 1, "user", "B."), (2, 5, "user", "no end"), (3, None, "user", "N."), (3, None, "user", "N."),
    (3, None, "assistant", "M."), (3, 4, "tool", "T."), (4, 0, "", ""), (4, 1, "user", " \n\t"), (5, 0, "system", "S."), (5, 1, "system", "S!"), (6, 0, "user", "x. " * 40000), (6, 1, "assistant", "y " * 40000 + "."),
    (7, 0, "Üser", "q."), (7, 9, "user", "é."), (7, 3, "assistant", "e. "), (8, 0, "system", "only."), (9, 2, "user", "x."), (9, 3, "assistant", "y."), (9, 4, "user", "x."), (9, 5, "assistant", "y."),
    (None, 1, "user", "null id."), *[(10, i, ["user", "assistant", "system"][i * 7 % 3], f"t{i * 5 % 17}.") for i in range(90)],
]


def test_whole_table(spark):
    schema = "conv_id long, turn long, role string, text string, pos int, audit string, edit int, key int, last int"
    df = spark.createDataFrame([(*r, 1, "z", 2, 3, 4) for r in ROWS], schema).repartition(5)
    repaired = T.repair(df)
    assert reported(repaired) == expected([(*r, True) for r in ROWS])
    turns = [r for r in repaired.collect() if r.pos >= 0]
    for conv in {r[0] for r in ROWS}:
        own = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.pos)
        assert [t.pos for t in own] == list(range(len(own))) and FITS.match("".join(t.role[0] for t in own))


def test_nulls_and_rows_that_are_not_there(spark):
    df = spark.createDataFrame([(1, 0, None, "x.", True), (1, 1, "user", None, True), (2, 0, "user", "x.", False), (3, 0, "user", "x.", None)], "conv_id long, turn long, role string, text string, there boolean")
    got = reported(T.repair(df, there_col="there"))
    assert got == expected([(1, 0, "", "x.", True), (1, 1, "user", "", True), (2, 0, "user", "x.", False), (3, 0, "user", "x.", True)])
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.report(T.repair(df)).collect() == []


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    return out


def test_the_query_on_damaged_rows(spark, tmp_path):
    rows = [*ROWS, *[(i, t, r, x) for i in range(100, 160) for t, (r, x) in enumerate([("system", "S."), ("user", "U?"), ("assistant", "A."), ("user", None), ("assistant", "Z.")])], (170, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op12_turn_repair(spark, str(tmp_path)).collect()
    want = expected(after_damage(rows))
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[n] for n in (*T.COUNTS, "repaired_sha256")) for r in got} == want
