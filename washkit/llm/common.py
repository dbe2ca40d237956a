"""Helpers shared by the training-data operators: intermediate tables, text columns, word hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed in one numpy step; bounds a task's memory whatever the batch holds.
CHUNK = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    In local mode, where driver and executor are one process, a temporary folder stands in
    when the setting is absent; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="washkit-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def table_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_OPEN = threading.local()  # tables written inside each open scratch(), innermost last


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends
    there, and the loss of an executor costs no recomputation of what is stored."""
    spark, path = df.sparkSession, table_dir(df.sparkSession, name)
    for paths in getattr(_OPEN, "scopes", [])[-1:]:
        paths.append(path)  # before the write, so a failed one's files go too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end the tables that :func:`stored` writes inside, by the calling thread.

    For a result that is written inside: ``with scratch(spark): operator(docs).write.parquet(path)``.
    A DataFrame made inside must not be used afterwards, as its operator's tables are gone; the files
    of ``path`` and those written before or by other threads stay. Scopes may be nested.
    """
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_alone(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """:func:`stored` of what ``make`` returns, without the tables that it needed on the way."""
    path = table_dir(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
        schema = df.schema
    for paths in getattr(_OPEN, "scopes", [])[-1:]:
        paths.append(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: Column | str) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.encode(c.cast("string"), "UTF-8"), F.lit(b""))


def digest(col: Column | str) -> Column:
    """128 bits of the text's UTF-8 bytes; a null text counts as empty."""
    return F.unhex(F.md5(utf8(col)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that may be sent to every task (8 bytes each); more are joined by a shuffle.
SENT_IDS = 1 << 20


def few(ids: DataFrame, most: int = SENT_IDS) -> bool:
    """Whether ``ids`` is counted to be small enough to be sent to every task."""
    return ids.limit(most + 1).count() <= most


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64 steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the polynomial's base and of its inverse, modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([one, np.cumprod(np.full(n, _MULT, np.uint64))])
            _INV = np.concatenate([one, np.cumprod(np.full(n, pow(_MULT, -1, 2**64), np.uint64))])
    return _POW, _INV


class Rolling:
    """Polynomial hashes of any substring of one byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        pw, self.inv = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * pw[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.inv[start]
            return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` (words parted by single or repeated spaces) cut between words into about CHUNK bytes."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= CHUNK else data.rfind(b" ", at, at + CHUNK) + 1
        if end <= at:  # one word longer than CHUNK
            end = data.find(b" ", at) + 1 or len(data)
        yield data[at:end]
        at = end


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashed(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit codes of the stretches of ``data`` from ``start`` to ``end``. Eight bytes at a time are
    mixed into the code by a bijection, so stretches of up to eight bytes and one length never
    collide, and longer ones have no algebraic collisions as a polynomial has."""
    words = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    left = end - start
    with np.errstate(over="ignore"):
        code = mix(left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        at, rows = start, None
        while len(at):
            v = words[at] & _KEPT[np.minimum(left, 8)]
            if rows is None:
                code = mix((code ^ v) * np.uint64(_MULT))
            else:
                code[rows] = mix((code[rows] ^ v) * np.uint64(_MULT))
            more = np.flatnonzero(left > 8)
            rows = more if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
    return code


def _coded(spaced: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit code of each space-separated word, in order."""
    starts, codes, at = [], [], 0
    for piece in pieces(spaced):
        a = np.frombuffer(piece, np.uint8)
        word = np.empty(len(a) + 2, np.bool_)
        word[0] = word[-1] = False
        np.not_equal(a, 32, out=word[1:-1])
        edge = np.flatnonzero(word[1:] != word[:-1])
        if len(edge):
            starts.append(edge[::2] + at)
            codes.append(hashed(piece, edge[::2], edge[1::2]))
        at += len(a)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(codes)


def coded_runs(spaced: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word codes of runs of texts that are hashed together: (index of the first text, codes,
    offsets); text ``first + i`` has ``codes[offsets[i]:offsets[i + 1]]``."""
    for first, run in by_texts(spaced, CHUNK // 4):
        starts, codes = _coded(b" ".join(run))
        yield first, codes, np.r_[0, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in run]))]


def word_codes(spaced: list[bytes]) -> Iterator[np.ndarray]:
    """For each text, the codes of its space-separated words."""
    for _, codes, offsets in coded_runs(spaced):
        yield from np.split(codes, offsets[1:-1])


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k-word sequences of a word-code array (empty when it is shorter)."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k), np.uint64)
        for t in range(k):
            h = h * np.uint64(_MULT) + codes[t : t + n]
        return mix(h)


def by_texts(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``size`` bytes: (index of the first, texts)."""
    first, run, total = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t)
        total += len(t) + 1
        if total >= size:
            yield first, run
            first, run, total = i + 1, [], 0
    if run:
        yield first, run


def groups_of(batches: Iterable, key: str, rows: int = 20000):
    """Regroup Arrow batches that arrive sorted by ``key`` so that no key is cut in two.

    Yields pyarrow tables of whole keys, of at least ``rows`` rows where there are that many.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        count += b.num_rows
        if count < rows:
            continue
        t = pa.concat_tables(held)
        k = t.column(key)
        last = pc.index(k, k[-1]).as_py()  # first row of the last, perhaps unfinished key
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        held, count = [t], t.num_rows if last else 0
    if held:
        yield pa.concat_tables(held)
