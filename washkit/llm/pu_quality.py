"""Quality classifier from positive and unlabelled documents.

Trusted positives are documents labelled good; the unlabelled set is a sample of all documents.
A small network is trained on the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

whose second term would otherwise fall below zero once the network fits the positives: then the
step is taken against it. The class prior is estimated as the least ratio of unlabelled to
positive mass above a score threshold of a held-back positive-against-unlabelled classifier.
Features, their means and deviations cover all documents; only the fit uses bounded samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import digest, stored, utf8, word_codes

#: Expected rows of the positive and of the unlabelled sample that the fit sees (all, where fewer); twice as many at most.
SAMPLE = 12000
HIDDEN, STEPS, BATCH = 32, 1500, 1000

_SPACES = bytes(32 if i == 32 or 9 <= i <= 13 else i for i in range(256))
_PUNCT = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[_PUNCT] = 1, 2, 3, 4, 5
WIDTH = 16 + len(_PUNCT)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text: sizes, shares of byte classes and of each
    punctuation mark, repetition of words and lines. Empty texts give zeros."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, (t, codes) in enumerate(zip(texts, word_codes([t.translate(_SPACES) for t in texts]), strict=True)):
        n, words = len(t), len(codes)
        if not words:
            continue
        seen = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        kinds = np.bincount(_CLASS, weights=seen, minlength=6) / n
        ordered = np.sort(codes)
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
        often = np.diff(edge)
        lines = [x for x in t.split(b"\n") if x.strip()]
        marks = seen[_PUNCT] / words
        out[i, :16] = (
            np.log1p(n), np.log1p(words), n / words, *kinds[1:], seen[10] / words, len(often) / words, often.max() / words,
            np.log(len(often)) / np.log(words) if words > 1 else 1.0, np.mean(codes[1:] == codes[:-1]) if words > 1 else 0.0,
            1 - len(set(lines)) / len(lines), kinds[1] / max(kinds[1] + kinds[2], 1e-9), marks.sum(),
        )
        out[i, 16:] = np.log1p(10 * marks)
    return out


def _featured(batches):
    import pyarrow as pa

    for b in batches:
        x = features(b.column("text").to_pylist())
        own = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], names=[*own, "x"])


def _summed(batches):
    import pyarrow as pa

    for b in batches:
        x = b.column("x").flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH)), pa.array(np.full(WIDTH, float(len(x)))), pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0))], names=["k", "n", "s", "q"])


class Network:
    """One hidden layer; ``logit(x)`` of the probability that a text is good."""

    def __init__(self, width: int, rng: np.random.Generator):
        self.w = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def step(self, x: np.ndarray, slope, rate: float = 0.003, decay: float = 1e-4) -> None:
        """One Adam step; ``slope(logits)`` is the loss's derivative by each logit."""
        h = np.tanh(x @ self.w[0] + self.w[1])
        d = slope(h @ self.w[2] + self.w[3][0])
        dh = d[:, None] * self.w[2] * (1 - h * h)
        self.t += 1
        for p, m, v, g in zip(self.w, self.m, self.v, (x.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()])), strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _trained(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int) -> Network:
    """prior None: plain positive-against-unlabelled; else the non-negative risk at that prior."""
    rng = np.random.default_rng(seed)
    net = Network(pos.shape[1], rng)
    for _ in range(STEPS):
        p, u = pos[rng.integers(0, len(pos), min(BATCH, len(pos)))], unl[rng.integers(0, len(unl), min(BATCH, len(unl)))]
        k = len(p)

        def slope(z, k=k, m=len(u)):
            s = sigmoid(z)
            d = np.zeros(len(z))
            if prior is None:
                d[:k], d[k:] = (s[:k] - 1) / k, s[k:] / m
                return d
            loss = np.logaddexp(0, z)  # of the label "bad"
            rest = loss[k:].mean() - prior * loss[:k].mean()
            sign = 1.0 if rest >= 0 else -1.0
            d[:k], d[k:] = -sign * prior * s[:k] / k, sign * s[k:] / m
            if rest >= 0:
                d[:k] += prior * (s[:k] - 1) / k
            return d

        net.step(np.concatenate([p, u]), slope)
    return net


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 5) -> float:
    """Share of positives among the unlabelled rows, from the halves that the scorer did not see."""
    net = _trained(pos[::2], unl[::2], None, seed)
    p, u = np.sort(net.logit(pos[1::2])), np.sort(net.logit(unl[1::2]))
    at = p[:: max(1, len(p) // 500)]
    above_p = 1 - np.searchsorted(p, at) / len(p)
    above_u = 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(200) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray) -> tuple[Network, float]:
    prior = class_prior(pos, unl)
    return _trained(pos, unl, prior, 11), prior


def _scored(model, mean: np.ndarray, dev: np.ndarray):
    w = None if model is None else [p.copy() for p in model.w]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = (b.column("x").flatten().to_numpy().reshape(-1, WIDTH) - mean) / dev
            s = np.full(len(x), 0.5) if w is None else sigmoid(np.tanh(np.clip(x, -6, 6) @ w[0] + w[1]) @ w[2] + w[3][0])
            own = [c for c in b.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(s)], names=[*own, "score"])

    return run


def held_out(id_col: Column | str) -> Column:
    """Rows whose labels are never learned from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   sample: int = SAMPLE, threshold: float = 0.3, key_col: str | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, with the binary ``key_col`` as key where given.

    score: probability that the text is good; predicted: 1 from ``threshold`` up. Only the text is
    scored. Labels are used of rows that are not held out and say 1; ``sample`` bounds the rows the
    fit sees (expected number of positives and of unlabelled rows, at most twice as many; each row
    is drawn for itself by a hash of its id, text and place in the stored features).
    A null text is empty; it is scored like any other. Rows with a null id are scored and count
    as not held out. Without any trusted positive every score is 0.5. Other columns are not read.
    """
    key, kind = ([F.col(key_col).alias("key")], "key binary, ") if key_col else ([], "")
    own = ["doc_id", "key"] if key_col else ["doc_id"]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, F.xxhash64(F.col(id_col).cast("long"), digest(text_col)).alias("draw"), utf8(text_col).alias("text"))
    drawn = base.mapInArrow(_featured, f"doc_id long, {kind}draw long, x array<float>")
    found = stored(drawn.withColumn("draw", F.xxhash64("draw", F.monotonically_increasing_id())), "features")
    stats = found.mapInArrow(_summed, "k long, n double, s double, q double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("k").collect()
    if not stats:
        return found.select(*own, held_out("doc_id").alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    n, s, q = (np.array([r[i] for r in stats]) for i in (1, 2, 3))
    mean = s / n
    dev = np.sqrt(np.maximum(q / n - mean * mean, 1e-6))

    def picked(df: DataFrame, salt: int) -> np.ndarray:
        rows = df.count()
        part = min(1.0, sample / max(rows, 1))
        draw = F.xxhash64("draw", F.lit(salt))
        got = df.where(F.pmod(draw, F.lit(1 << 30)) < int(part * (1 << 30))).orderBy(draw).limit(2 * sample).select("x").toArrow()
        x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)  # no object a number in the driver
        return np.clip((x - mean) / dev, -6, 6)

    good = labels.where((F.col(label_col) == 1) & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    pos = picked(stored(found.join(good, "doc_id", "left_semi"), "positives"), 1)
    unl = picked(found, 2)
    model = fit(pos, unl)[0] if len(pos) >= 2 and len(unl) >= 2 else None
    out = found.drop("draw").mapInArrow(_scored(model, mean, dev), f"doc_id long, {kind}score double")
    return out.select(*own, held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
