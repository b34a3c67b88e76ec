"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; all texts of the corpus are the
unlabelled set.  A linear scorer g minimises the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss l, so the sigmoid of g estimates the probability of quality 1.
Where the bracket isn't negative the risk is E_U[l(-g)] - prior * E_P[g], as
l(g) - l(-g) = -g, which is convex: Newton's method finds its minimum in a few rounds,
with a ridge of ``DECAY``.  A minimum whose bracket is negative overfits the unlabelled
part; then the scorer is drawn back towards zero until the bracket isn't negative.

The class prior is estimated from positives and unlabelled text alone: a first fit
with prior 1/2 ranks texts.  Above a high score both sets hold positives only, so
there (unlabelled share / positive share) is the prior; the median over thresholds at
the positives' quantiles 0.1 to 0.7 is taken, ``MIN_PRIOR`` at least, ``MAX_PRIOR`` at
most.

Features describe the form of the text, not its words: shares of byte classes and
punctuation marks, upper case, word and line lengths (by their logarithms), shares of
distinct words, word pairs and lines, and the most frequent word's and line's share.
They are standardised by means and spreads between their quantiles ``TAIL`` and
1 - ``TAIL``, clipped at ``CLIP``, and drawn into a ball of radius ``BALL``, so that no text,
however odd, weighs much more than another.

Positives that are learnt from are ``max_train_docs`` / 2 at most, not held out and chosen
by a hash of the id; their features come to the driver.  All else covers every text:
quantiles (from counts of bins), the risk's unlabelled part in each round (loss,
gradient and second derivatives are one aggregation), and the prior's counts.  Sums are
of integers, so that the order in which tasks end changes nothing.  The features of a
text are written once (about 0.2 KB) and read by each of these steps and by the
scoring, which applies a model of two numbers a feature on the executors.

Edge cases: null and empty texts are scored like any other (all shares 0); a null or
empty text never trains, nor counts in quantiles, risk and prior.  Each row counts there,
repeated ones too.  Without positives the score is 0.5 everywhere.  Rows with a
null id count as not held out.  Repeated rows are scored alike.  Of rows that repeat a
training id with different texts, the one with the least features is learnt from.  A
text is scored whole, however long.  Other columns are ignored, whatever their names;
ids must be integers.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_held_out
from .kernels import CHUNK_BYTES, Piece, pieces, shingles, words

MIN_PRIOR, MAX_PRIOR = 0.05, 0.97
#: Share of texts below and above which a feature doesn't count in its mean and spread; bounds of a standardised feature and of all together.
TAIL, CLIP, BALL = 0.05, 3.0, 7.0
DECAY = 0.03
#: Values are summed in units of 1 / _UNIT, over so many rows at most, and counted in bins of 1 / _BIN up to _BINS.
_UNIT, _ROWS, _BIN, _BINS = 1 << 32, 100_000, 1024, 8192
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Byte classes: lower case, upper case, digit, white space, line break, control, non-ASCII, then each mark.
_CLASS = np.full(256, 5)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[128:] = 6
_CLASS[_MARKS] = 7 + np.arange(len(_MARKS))
N_CLASSES = 7 + len(_MARKS)
N_FEATURES = N_CLASSES + 10
_NEWLINE = np.arange(256) == 10


def _distinct(h: np.ndarray) -> tuple[float, float]:
    """Share of distinct values, and the most frequent value's share."""
    if not len(h):
        return 0.0, 0.0
    s = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return len(first) / len(h), np.diff(first, append=len(h)).max() / len(h)


def piece_features(p: Piece) -> np.ndarray:
    n = len(p)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    size = np.diff(p.offsets)
    counts = np.zeros(n * N_CLASSES, dtype=np.int64)
    for at in range(0, len(p.data), CHUNK_BYTES):
        x = p.data[at : at + CHUNK_BYTES]
        lo, hi = np.searchsorted(p.offsets, [at, at + len(x) - 1], side="right") - 1
        bounds = np.clip(p.offsets[lo : hi + 2], at, at + len(x))
        part = np.bincount(np.repeat(np.arange(hi - lo + 1) * N_CLASSES, np.diff(bounds)) + _CLASS[x])
        counts[lo * N_CLASSES : lo * N_CLASSES + len(part)] += part
    counts = counts.reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    w, lines = words(p), words(p, _NEWLINE)
    pairs = shingles(w.hash, 2)
    length = w.end - w.start
    for k in range(n):
        a, b = w.of_text[k], w.of_text[k + 1]
        x = out[k, N_CLASSES:]
        x[0] = np.log1p(b - a) / 10
        if b > a:
            x[1], x[2] = np.log1p(length[a:b].mean()) / 4, np.log1p(length[a:b].std()) / 4
            x[3], x[4] = _distinct(w.hash[a:b])
            x[5], x[6] = _distinct(pairs[a : b - 1])
            c, d = lines.of_text[k], lines.of_text[k + 1]
            x[7], x[8] = _distinct(lines.hash[c:d])
            x[9] = np.log1p((b - a) / (d - c)) / 10
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    parts = [piece_features(p) for p in pieces(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), dtype=np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = _expand((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their absolute values (too much and too little of a thing both tell), within a ball."""
    z = np.clip(z, -CLIP, CLIP)
    z = np.concatenate([z, np.abs(z)], axis=1)
    return z * np.minimum(1, BALL / np.maximum(np.linalg.norm(z, axis=1), 1e-9))[:, None]


#: Mean over the unlabelled rows of the loss l(-g), its gradient and its second derivatives, by the parameters (the bias is the last).
Losses = Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def _loss_sums(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sums over rows: the loss, its gradient, and the upper triangle of its second derivatives."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    g = np.clip(x @ theta, -500, 500)
    s = 1 / (1 + np.exp(-g))
    second = (x * (s * (1 - s))[:, None]).T @ x
    return np.concatenate([[np.logaddexp(0, g).sum()], x.T @ s, second[np.triu_indices(len(theta))]])


def _of_sums(sums: np.ndarray, n: float, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    second = np.zeros((size, size))
    second[np.triu_indices(size)] = sums[1 + size :] / n
    return sums[0] / n, sums[1 : 1 + size] / n, second + np.triu(second, 1).T


def losses_of(u: np.ndarray) -> Losses:
    """Of rows that are held in memory."""
    return lambda theta: _of_sums(_loss_sums(u, theta), len(u), len(theta))


def minimise(p: np.ndarray, losses: Losses, prior: float, decay: float = DECAY, start: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, given positives ``p`` and the unlabelled rows' losses."""
    p1 = np.concatenate([p, np.ones((len(p), 1))], axis=1)
    mean = p1.mean(0)
    ridge = np.full(p1.shape[1], decay)
    ridge[-1] = 1e-9

    def risk(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        loss, slope, second = losses(theta)
        bracket = loss - prior * np.logaddexp(0, p1 @ theta).mean()
        return loss - prior * float(mean @ theta) + float(ridge @ theta**2) / 2, slope - prior * mean + ridge * theta, second + np.diag(ridge), bracket

    theta = np.zeros(p1.shape[1]) if start is None else start
    value, slope, second, bracket = risk(theta)
    for _ in range(rounds):
        step, share = np.linalg.solve(second, slope), 1.0
        got = risk(theta - step)
        while got[0] > value and share > 1e-4:
            share /= 2
            got = risk(theta - share * step)
        gain, theta = value - got[0], theta - share * step
        value, slope, second, bracket = got
        if gain < 1e-7:
            break
    if bracket < 0:  # at zero it is (1 - prior) * log 2
        kept, gone = 0.0, 1.0
        for _ in range(10):
            middle = (kept + gone) / 2
            kept, gone = (middle, gone) if risk(middle * theta)[3] >= 0 else (kept, middle)
        theta = kept * theta
    return theta[:-1], float(theta[-1])


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """``minimise`` over rows that are held in memory."""
    return minimise(p, losses_of(u), prior, decay)


def _ratio_points(p: np.ndarray, losses: Losses) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """The ranking scorer's weights and bias, its thresholds in rising order, and the share of ``p`` at or above each."""
    w, b = minimise(p, losses, 0.5)
    g = p @ w + b
    at = np.quantile(g, np.arange(0.1, 0.7, 0.02))
    return w, b, at, (g[:, None] >= at).mean(0)


def _counts_above(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many values are at or above each of the rising thresholds."""
    return len(g) - np.searchsorted(np.sort(g), at, side="left")


def _prior(of_unlabelled: np.ndarray, of_positive: np.ndarray) -> float:
    return float(min(MAX_PRIOR, max(MIN_PRIOR, np.median(of_unlabelled / of_positive))))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in ``u``: positives are ranked high, so above high scores both hold positives only."""
    w, b, at, shares = _ratio_points(p, losses_of(u))
    return _prior(_counts_above(u @ w + b, at) / len(u), shares)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, filled (the text is neither null nor empty), x (the features as float32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "filled", "x"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), (text != "").alias("filled"), text.alias("text")).mapInArrow(run, "id bigint, filled boolean, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES)


def _corpus_sums(rows: DataFrame, names: list[str], of_batch) -> dict[str, np.ndarray]:
    """Sums over all filled rows: ``of_batch`` makes of a batch's features one array of int64 a name, all of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array(np.arange(len(total[0]))), pa.array(np.full(len(total[0]), n)), *map(pa.array, total)], ["k", "n", *names])
        for batch in batches:
            if batch.num_rows:
                part = of_batch(_matrix(batch.column(0)))
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                n += batch.num_rows
            if n >= _ROWS:  # a bound of the sums
                yield done()
                total, n = None, 0
        if total is not None:
            yield done()

    parts = rows.filter("filled").select("x").mapInArrow(run, "k bigint, n bigint, " + ", ".join(f"{c} bigint" for c in names))
    # decimals: exact beyond the range of bigint
    sums = parts.groupBy("k").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]).orderBy("k").collect()
    return {c: np.array([float(r[c]) for r in sums]) for c in ("n", *names)}


def _bin_counts(rows: DataFrame) -> np.ndarray:
    """How many filled rows have each feature in each bin: a grid of fixed size, of which tasks send what isn't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_FEATURES * _BINS, np.int64)
        for batch in batches:
            if batch.num_rows:
                at = np.clip(np.floor(_matrix(batch.column(0)) * _BIN).astype(np.int64), 0, _BINS - 1)
                total += np.bincount((at + np.arange(N_FEATURES) * _BINS).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    found = rows.filter("filled").select("x").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N_FEATURES * _BINS, np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(N_FEATURES, _BINS)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature from its counts, values beyond the quantiles ``TAIL`` and 1 - ``TAIL`` taken as these."""
    middle = (np.arange(_BINS) + 0.5) / _BIN
    mean, scale = np.zeros(len(counts)), np.zeros(len(counts))
    for k, c in enumerate(counts):
        below = np.cumsum(c)
        lo, hi = np.searchsorted(below, [TAIL * below[-1], (1 - TAIL) * below[-1]])
        x = np.clip(middle, middle[lo], middle[hi])
        mean[k] = c @ x / below[-1]
        scale[k] = np.sqrt(c @ (x - mean[k]) ** 2 / below[-1]) + 1e-3
    return mean, scale


def train_on(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_train_docs: int = 8000) -> Model | None:
    """The model learnt from a frame that ``features`` made, which is read several times."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y = 1")
    positives = known.filter(~is_held_out(F.col("_id"))).select(F.col("_id").cast("bigint")).distinct().orderBy(F.xxhash64("_id")).limit(max_train_docs // 2)
    chosen = F.broadcast(positives)  # max_train_docs / 2 rows at most
    got = rows.filter("filled").join(chosen, F.col("id") == F.col("_id")).groupBy("id").agg(F.min("x").alias("x")).orderBy("id").toArrow()
    if not got.num_rows:
        return None
    mean, scale = _spread(_bin_counts(rows))
    p = _expand((_matrix(got.column("x")) - mean) / scale)

    def losses(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = _corpus_sums(rows, ["s"], lambda x: [np.rint(_loss_sums(_expand((x - mean) / scale), theta) * _UNIT).astype(np.int64)])
        return _of_sums(sums["s"] / _UNIT, sums["n"][0], len(theta))

    w, b, at, shares = _ratio_points(p, losses)
    above = _corpus_sums(rows, ["above"], lambda x: [_counts_above(_expand((x - mean) / scale) @ w + b, at)])
    prior = _prior(above["above"] / above["n"], shares)
    return Model(mean, scale, *minimise(p, losses, prior, start=np.append(w, b)), prior)


def score_rows(rows: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``features``: id, score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            s = np.full(len(x), 0.5) if shared.value is None else shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(np.float64))], ["id", "score"])

    return rows.select("id", "x").mapInArrow(run, "id bigint, score double").withColumnRenamed("id", id_col)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_train_docs: int = 8000) -> Model | None:
    return train_on(durable(features(docs, id_col, text_col)), labels, id_col, label, max_train_docs)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, score."""
    return score_rows(features(docs, id_col, text_col), model, id_col)


def train_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_train_docs: int = 8000) -> DataFrame:
    """``score`` of ``train``, with the texts read once."""
    rows = durable(features(docs, id_col, text_col))
    return score_rows(rows, train_on(rows, labels, id_col, label, max_train_docs), id_col)
