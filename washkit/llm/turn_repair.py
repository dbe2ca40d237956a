"""Repair of conversation structure by least-cost edits, with Four-Russians block tables.

Rows are symbols: a role class (system, user, assistant, other), sound or truncated, or a row that
must go. A repaired conversation is empty or an optional system turn and then pairs of user and
assistant, an automaton of four states. The cheapest edits from every state to the end are a
vector of four costs, and with its least entry taken off only a few dozen vectors exist. For each
of them and every block of ``BLOCK`` symbols a table holds the vector before the block and the
cost taken off, so a conversation is solved by one lookup a block, from its last block to its first.

The trace goes forward from the start state. A block is expanded backward from the vector at its
right end, and of the edits that keep to the least cost the first in ASCII order is taken: costs to
the end are exact at every place, so the audit is the least string of all cheapest ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import digest, stored

DELETE, RETAG, INSERT, TRUNCATED = 2, 1, 5, 5
#: Symbols of a block, and the symbol that fills the first one.
BLOCK, FILL = 4, 9
SYMBOLS = 9  # 0-3: sound row with role s, u, a, other; 4-7: the same, truncated; 8: must go
#: The state that a turn of role s, u, a leads to from states 0 (start), 1 (after s), 2 (after u), 3 (after a).
STEPS = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: The role that fits a state besides s, as state reached and name.
FITS = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))

END = (0, 2 * INSERT, INSERT, 0)


def _step(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to the end before a row of ``symbol``, from the costs after it."""
    best = [DELETE + c for c in after]
    if symbol < 8:
        role, more = symbol % 4, TRUNCATED * (symbol >= 4)
        for q in range(4):
            kept = STEPS[q][role] if role < 3 else None
            best[q] = min(best[q], RETAG + more + after[FITS[q][0]], *([more + after[kept]] if kept is not None else []))
    for _ in range(3):
        best = [min(c, INSERT + best[FITS[q][0]]) for q, c in enumerate(best)]
    return tuple(best)


class Tables:
    """The normalised vectors, and for each of them and every symbol or block the vector before it
    and the cost taken off."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, number = [END], {END: 0}
        step, cost = [], []
        for v in self.vectors:  # grows while new vectors are found
            row, off = [], []
            for symbol in range(SYMBOLS):
                before = _step(v, symbol)
                low = min(before)
                norm = tuple(c - low for c in before)
                if norm not in number:
                    number[norm] = len(self.vectors)
                    self.vectors.append(norm)
                row.append(number[norm])
                off.append(low)
            step.append([*row, number[v]])
            cost.append([*off, 0])
        self.step, self.cost = np.array(step, np.int32), np.array(cost, np.int32)
        self.step_blocks, self.cost_blocks = self.step, self.cost
        for _ in range(block - 1):  # one symbol more, put before the block
            left = self.step[self.step_blocks]  # (vector, block, symbol)
            off = self.cost_blocks[:, :, None] + self.cost[self.step_blocks]
            self.step_blocks = left.transpose(0, 2, 1).reshape(len(step), -1)
            self.cost_blocks = off.transpose(0, 2, 1).reshape(len(step), -1)
        self.expand = lru_cache(1 << 16)(self._expand)

    def _expand(self, code: int, vector: int, state: int) -> tuple[str, int]:
        """Edits of one block from ``state`` with ``vector`` at its right end; the state after it."""
        symbols = [code // (SYMBOLS + 1) ** k % (SYMBOLS + 1) for k in range(self.block)][::-1]
        right = [vector]
        for s in reversed(symbols):
            right.append(int(self.step[right[-1], s]))
        right.reverse()
        edits = []
        for k, s in enumerate(symbols):
            if s == FILL:
                continue
            after = self.vectors[right[k + 1]]
            before = [c + int(self.cost[right[k + 1], s]) for c in self.vectors[right[k]]]
            more, role = TRUNCATED * (4 <= s < 8), s % 4
            while True:
                kept = STEPS[state][role] if s < 8 and role < 3 else None
                fit = FITS[state][0]
                if before[state] == DELETE + after[state]:
                    edits.append("D")
                elif before[state] == INSERT + before[fit]:
                    edits.append("I")
                    state = fit
                    continue
                elif kept is not None and before[state] == more + after[kept]:
                    edits.append("K")
                    state = kept
                else:
                    edits.append("R")
                    state = fit
                break
        return "".join(edits), state

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """(least cost, audit) of a conversation."""
        if not symbols:
            return 0, ""
        x = np.frombuffer(bytes([FILL]) * (-len(symbols) % self.block) + symbols, np.uint8).reshape(-1, self.block).astype(np.int64)
        codes = (x @ ((SYMBOLS + 1) ** np.arange(self.block - 1, -1, -1))).tolist()
        step, cost = self.step_blocks, self.cost_blocks
        right, total, v = np.empty(len(codes), np.int32), 0, 0
        for k in range(len(codes) - 1, -1, -1):
            right[k] = v
            total += int(cost[v, codes[k]])
            v = int(step[v, codes[k]])
        total += self.vectors[v][0]
        state, edits = 0, []
        for k, code in enumerate(codes):
            found, state = self.expand(code, int(right[k]), state)
            edits.append(found)
        while END[state]:
            edits.append("I")
            state = FITS[state][0]
        return total, "".join(edits)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROW = "conv_id long, pos long, role string, text string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _analysed(batches) -> Iterator:
    """Rows in order -> the same rows numbered, and after each conversation's one with position -1
    that holds its counts and audit. A conversation's symbols are held, one byte a row, not its texts."""
    import pyarrow as pa

    tables = Tables()
    started, conv, pos, symbols = False, None, 0, bytearray()
    counts, turns, last, seen = [0, 0, 0, 0], [None, None, 0], None, None

    def closed():
        cost, audit = tables.solve(bytes(symbols))
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        return [gaps, *counts, cost, audit]

    ends: list[tuple] = []
    for b in batches:
        convs, turn, role, fault, there = (b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "there"))
        texts = b.column("text")
        place = []
        for i, c in enumerate(convs):
            if not started or c != conv:
                if started:
                    ends.append((conv, closed()))
                started, conv, pos, symbols = True, c, 0, bytearray()
                counts, turns, last, seen = [0, 0, 0, 0], [None, None, 0], None, None
            if not there[i]:
                place.append(None)
                continue
            place.append(pos)
            pos += 1
            t, r, f = turn[i], role[i], fault[i]
            if t is not None and t != turns[1]:
                turns = [t if turns[0] is None else turns[0], t, turns[2] + 1]
            if f != 1:
                text = texts[i]
                if f != 2 and seen is not None and seen[0] == t and seen[1] == r and seen[2].equals(text):
                    f = 2
                seen = (t, r, text)
            kind = r[:1]
            if last is not None and (last, kind) not in (("s", "u"), ("u", "a"), ("a", "u")):
                counts[3] += 1
            last = kind
            if f:
                counts[f - 1] += 1
            symbols.append(8 if f in (1, 2) else {"s": 0, "u": 1, "a": 2}.get(kind, 3) + 4 * (f == 3))
        keep = pa.array([p is not None for p in place], pa.bool_())
        n = len(place)
        rows = pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(place, pa.int64()), b.column("role"), b.column("text"), *(pa.nulls(n, pa.int64()) for _ in COUNTS[:-1]), pa.nulls(n, pa.string())],
                                          names=["conv_id", "pos", "role", "text", *COUNTS])
        yield rows.filter(keep)
        if ends:
            yield _ends(ends)
            ends = []
    if started:
        yield _ends([(conv, closed())])


def _ends(ends: list[tuple]):
    import pyarrow as pa

    n = len(ends)
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in ends], pa.int64()), pa.array([-1] * n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
         *(pa.array([v[k] for _, v in ends], pa.int64() if k < len(COUNTS) - 1 else pa.string()) for k in range(len(COUNTS)))],
        names=["conv_id", "pos", "role", "text", *COUNTS])


def _repaired(batches) -> Iterator:
    """The report row of a conversation, then its rows -> the same report row, then its repaired turns."""
    import pyarrow as pa

    audit, at, state, conv, pos = "", 0, 0, None, 0
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "pos", "role", "text", "edit", *COUNTS)}

        def put(role, text, edit, report=(None,) * len(COUNTS), place=None):
            for k, v in zip(out, (conv, pos if place is None else place, role, text, edit, *report), strict=True):  # noqa: B023
                out[k].append(v)  # noqa: B023

        def inserted():
            nonlocal at, state, pos
            while at < len(audit) and audit[at] == "I":
                put(FITS[state][1], "", "I")
                at, state, pos = at + 1, FITS[state][0], pos + 1

        columns = [b.column(c).to_pylist() for c in ("conv_id", "pos", "role", *COUNTS)]
        texts = b.column("text")
        for i, (c, p, role, *report) in enumerate(zip(*columns, strict=True)):
            if p == -1:
                inserted()
                conv, audit, at, state, pos = c, report[-1], 0, 0, 0
                put(None, None, None, report, -1)
                if audit and audit.count("I") == len(audit):
                    inserted()
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "K":
                state = STEPS[state]["sua".index(role[:1])]
            else:
                state, role = FITS[state]
            put(role, texts[i].as_py(), edit)
            pos += 1
        if at < len(audit) and audit[at:].count("I") == len(audit) - at:  # nothing but insertions follows
            inserted()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * (len(COUNTS) - 1), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there_col: str | None = None) -> DataFrame:
    """A report row for each conversation (pos -1: gaps, blank, duplicate, truncated, illegal, cost,
    audit), followed in its partition by the repaired turns in order (pos from 0, role, text, edit).

    A conversation's rows are taken by turn (nulls first), then by role and text. A row's first
    fault counts: blank (only white space), duplicate (role and text seen earlier in the
    conversation), truncated (last character that is no white space not one of ``.!?``). Null roles
    and texts are empty. Rows with a null id are one conversation. Where ``there_col`` is false a
    row is not there, but its conversation is reported; one without rows has zeros and an empty
    audit. Repeated rows are duplicates. Other columns are not read.
    """
    there = F.coalesce(F.col(there_col), F.lit(True)) if there_col else F.lit(True)
    base = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), there.alias("there"))
    white = r"[\x20\x09-\x0D]"
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){white}*\z", 1)
    base = stored(base.withColumn("last", last).withColumn("key", digest("text")), "turns")
    said = base.where("there AND last <> ''")
    often = said.groupBy("conv_id", "role", "key").agg(F.count("*").alias("c"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")).where("c > 1") \
        .select(F.col("conv_id").alias("of_id"), F.col("role").alias("of_role"), F.col("key").alias("of_key"), "first.turn", F.lit(True).alias("often")).withColumnRenamed("turn", "of_turn")
    on = F.col("conv_id").eqNullSafe(F.col("of_id")) & (F.col("role") == F.col("of_role")) & (F.col("key") == F.col("of_key"))
    later = F.coalesce(F.col("often"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("of_turn"))
    fault = F.when(F.col("last") == "", 1).when(later, 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    ordered = base.join(often, on, "left").select("conv_id", "turn", "role", "text", "there", fault.alias("fault")) \
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    known = stored(ordered.mapInArrow(_analysed, f"{ROW}, {REPORT}"), "analysed")
    return known.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_repaired, f"{ROW}, edit string, {REPORT}")


def _hashed(batches) -> Iterator:
    import pyarrow as pa

    names = ["conv_id", *COUNTS, "repaired_sha256"]
    kinds = (pa.int64(), *[pa.int64()] * (len(COUNTS) - 1), pa.string(), pa.string())
    now, sha = None, None

    def batch(done):
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=names)

    for b in batches:
        done = []
        texts = b.column("text")
        for i, (conv, pos, role, *report) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "pos", "role", *COUNTS)), strict=True)):
            if pos == -1:
                if now:
                    done.append([*now, sha.hexdigest()])
                now, sha = [conv, *report], hashlib.sha256()
            else:
                sha.update(f"{chr(10) if pos else ''}{role}:{texts[i].as_py()}".encode())
        if done:
            yield batch(done)
    if now:
        yield batch([[*now, sha.hexdigest()]])


def report(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`'s rows, as they come: counts, audit, digest
    of the repaired turns (``role:text``, joined by line feeds)."""
    return repaired.mapInArrow(_hashed, f"conv_id long, {REPORT}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows with the damage that the query repairs: by crc32 of ``conv_id:turn``
    modulo 20 a row is gone (0), its text empty (1) or without ``.!?`` (2), repeated (3), or its
    role user (4). Nulls are one space."""
    space = F.lit(" ")
    kind = F.pmod(F.crc32(F.encode(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)), "UTF-8")), F.lit(20))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind != 0).alias("there"),
                       F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")
