"""Chat formatting at token level.

A turn is ``### <role>: <text></turn>`` and a line feed. Role and text are encoded on their own, so
no merge ever spans a mark, and the three marks are reserved ids spliced between the segments: no
content can make them. The loss mask is a prefix sum of +1 where a trained segment begins and -1
where it ends, and a turn's place in its conversation a prefix sum of token counts.

The formatted text needs the marks escaped where content holds them: each control string gets a
backslash, and backslashes before a control string or at a segment's end are doubled. A control
string after an odd number of backslashes is content, after an even number a mark; other
backslashes are left alone. So both forms, ids and text, can be read back without loss.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import stored

#: Rank file of the byte-level vocabulary, read on the driver and sent to the tasks (about 1 MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of that rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The marks; their ids follow the vocabulary's in this order.
TURN, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
#: Control strings escaped in texts, and those escaped in roles besides.
CONTROLS, ROLE_CONTROLS = ("### ", "</turn>", "<|endoftext|>"), (": ",)
#: Code points of a segment that are encoded in one call; longer segments are cut, before a space where there is one.
PIECE = 1 << 16


def _pattern(controls: Sequence[str]) -> str:
    return "|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True))


def escape(text: str, controls: Sequence[str] = CONTROLS) -> str:
    """``text`` with its control strings escaped."""
    return re.sub(r"(\\*)(" + _pattern(controls) + r"|\Z)", lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str, controls: Sequence[str] = CONTROLS) -> str:
    """The text of which ``text`` is the escaped form."""
    return re.sub(r"(\\*)(" + _pattern(controls) + r"|\Z)", lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, at = [], 0

    def until(mark: str, controls: Sequence[str]) -> str:
        nonlocal at
        scan = re.compile(r"(\\*)(" + _pattern(controls) + ")")
        for m in scan.finditer(formatted, at):
            if len(m[1]) % 2 == 0 and formatted.startswith(mark, m.start(2)):
                found, at = formatted[at : m.start(2)], m.start(2) + len(mark)
                return unescape(found, controls)
        raise ValueError(f"no {mark!r} from {at} on")

    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        at += len(TURN)
        role = until(ROLE_END, CONTROLS + ROLE_CONTROLS)
        turns.append((role, until(TURN_END, CONTROLS)))
    return turns


class Codec:
    """Encoder and decoder of turns over one rank file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self._encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.turn = max(table.values()) + 1
        self.role_end, self.turn_end = self.turn + 1, self.turn + 2

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                end = at + PIECE
                space = text.rfind(" ", at + 1, end)
                end = space if space > at else end
            out += self._encoding.encode_ordinary(text[at:end])
            at = end
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return self._encoding.decode_bytes(list(ids)).decode("utf-8")

    def assemble(self, turns: Sequence[tuple[str, str]], trained: Sequence[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and loss mask of all turns, one after the other, and where each turn begins."""
        ids: list[int] = []
        begins, ends, marks = [0], [], []
        for role, text in turns:
            ids.append(self.turn)
            ids += self.encode(escape(role, CONTROLS + ROLE_CONTROLS))
            ids.append(self.role_end)
            marks.append(len(ids))
            ids += self.encode(escape(text))
            ends.append(len(ids))
            ids.append(self.turn_end)
            begins.append(len(ids))
        step = np.zeros(len(ids) + 1, np.int32)
        on = np.asarray(trained, np.int32)
        np.add.at(step, np.asarray(marks, np.int64), on)
        np.add.at(step, np.asarray(ends, np.int64), -on)
        return np.asarray(ids, np.int32), np.cumsum(step[:-1], dtype=np.int32).astype(np.int8), np.asarray(begins, np.int64)

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of each turn in ``ids``."""
        starts, middles, ends = (np.flatnonzero(ids == x) for x in (self.turn, self.role_end, self.turn_end))
        return [(unescape(self.decode(ids[a + 1 : b]), CONTROLS + ROLE_CONTROLS), unescape(self.decode(ids[b + 1 : c]))) for a, b, c in zip(starts, middles, ends, strict=True)]

    def trained_texts(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts under the mask, one for each of its runs."""
        edge = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
        return [unescape(self.decode(ids[a:b])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def render(role: str, text: str) -> str:
    return TURN + escape(role, CONTROLS + ROLE_CONTROLS) + ROLE_END + escape(text) + TURN_END


#: Code points of a batch's turns that are assembled at a time.
RUN = 1 << 20

TURN_ROW = "conv_id long, turn long, ids array<int>, loss_mask array<tinyint>, formatted string"


def _encoded(ranks, pattern: str, trained: frozenset[str]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        codec = Codec(ranks.value, pattern)
        for b in batches:
            turns = list(zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
            at = 0
            while at < len(turns):
                end, size = at, 0
                while end < len(turns) and (end == at or size + len(turns[end][1]) <= RUN):
                    size += len(turns[end][1])
                    end += 1
                part = turns[at:end]
                ids, mask, begins = codec.assemble(part, [r in trained for r, _ in part])
                offsets = pa.array(begins.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id").slice(at, end - at), b.column("turn").slice(at, end - at), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                     pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array([render(*t) for t in part], pa.string())],
                    names=["conv_id", "turn", "ids", "loss_mask", "formatted"])
                at = end

    return run


def _placed(batches) -> Iterator:
    """Adds each turn's position and first token, prefix sums over its conversation's turns in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    last, position, start = object(), 0, 0
    for b in batches:
        positions, starts = [], []
        for conv, n in zip(b.column("conv_id").to_pylist(), pc.list_value_length(b.column("ids")).to_pylist(), strict=True):
            if conv != last:
                last, position, start = conv, 0, 0
            positions.append(position)
            starts.append(start)
            position, start = position + 1, start + n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(positions, pa.int64()), pa.array(starts, pa.int64())], names=[*b.schema.names, "position", "token_start"])


def _ranks(df: DataFrame, tokenizer: str):
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def format_conversations(df: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, trained: Sequence[str] = ("assistant",), id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, ids, loss_mask, formatted, position, token_start): one row for each row of ``df``.

    A conversation's rows stand together and in order: by turn (nulls first), then by formatted
    text, so repeated rows follow each other. Null roles and texts are empty; an empty text has no
    token under the mask. Rows with a null id are one conversation. Other columns are not read, and
    an empty table gives none. Turns are encoded where they are read; only ``position`` and
    ``token_start`` need a conversation in order, which is streamed, never held.
    """
    empty = F.lit("")
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    turns = stored(rows.mapInArrow(_encoded(_ranks(df, tokenizer), pattern, frozenset(trained)), TURN_ROW), "turns")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(_placed, TURN_ROW + ", position long, token_start long")


def _digests(ranks, pattern: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        codec = Codec(ranks.value, pattern)
        done: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        now = None  # (conversation, turns, hash of turns, trained code points, hash of them, formatted code points)

        def close():
            if now:
                for k, v in zip(done, (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]), strict=True):
                    done[k].append(v)

        def out():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(done.values(), kinds, strict=True)], names=list(done))
            for v in done.values():
                v.clear()
            return batch

        for b in batches:
            for i, conv in enumerate(b.column("conv_id").to_pylist()):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = (b.column(c)[i].values.to_numpy() for c in ("ids", "loss_mask"))
                for role, text in codec.read(ids):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for text in codec.trained_texts(ids, mask):
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(b.column("formatted")[i].as_py())
            if done["conv_id"]:
                yield out()
        close()
        yield out()

    return run


def read_back(chat: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, in_order: bool = False) -> DataFrame:
    """Per conversation, what the ids, the mask and the formatted text of ``chat`` hold: turns and
    their digest, trained code points and their digest, formatted code points. ``in_order``: the
    rows come as :func:`format_conversations` returns them, so they are not shuffled again."""
    rows = chat if in_order else chat.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.select("conv_id", "ids", "loss_mask", "formatted").mapInArrow(
        _digests(_ranks(chat, tokenizer), pattern), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
