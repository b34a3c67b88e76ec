"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at . ! ? and line breaks).  A sentence's
logit is a bias plus the weights of its hashed words and word beginnings; a
document is toxic if any sentence is, so sentence probabilities are combined by
noisy-or: P = 1 - prod(1 - p_s).  Only document labels are known; the weights are
trained by their likelihood through the noisy-or, after which the sentence
probabilities locate the offending sentences.  Only features whose presence goes with
the label (a likelihood-ratio test) get a weight.

Training takes labelled rows that are not held out, ``max_train_docs`` at most (the
positives first, up to half; both by a hash of the id) and of those as many, in the
order of a hash, as have ``MAX_TRAIN_BYTES`` together (none of over ``MAX_TEXT_BYTES``);
it runs on the driver, whose input these bounds limit.  Scoring covers whole texts on the executors; the shared
model has a fixed size of 2 ** ``HASH_BITS`` numbers.

Edge cases: null and empty texts have no sentence and score 0.  Labels that are null,
or rows without a text, are not learnt from; of several labels of an id the largest
counts.  Without any label of both kinds the model scores 0 everywhere.  Rows with a
null id count as not held out and are scored.  Repeated rows are scored alike.  Of
rows that repeat a labelled id with different texts, the least text is learnt from.  A
text is scored whole, however long; a worker then takes some 30 bytes a word of the
longest one.  Other columns are ignored, whatever their names; ids must be integers.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, is_held_out
from .kernels import NOT_WORD, Chunk, Piece, U, Words, pieces, words

HASH_BITS = 18
#: Word beginnings of so many bytes are features besides the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of text that training takes at most, and of one text that is learnt from.
MAX_TRAIN_BYTES, MAX_TEXT_BYTES = 64 << 20, 1 << 20
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def features(w: Chunk) -> np.ndarray:
    """Feature numbers, one row a word: the whole word and its beginnings."""
    return np.stack([(h >> U(64 - HASH_BITS)).astype(np.int32) for h in (w.whole, *map(w.prefix, PREFIXES))], axis=1)


def characters(data: np.ndarray) -> int:
    """Characters of UTF-8 bytes (lower-casing changes bytes, but no character's place)."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def sentences(p: Piece, w: Words) -> np.ndarray:
    """Index of the first word of each sentence that has words."""
    behind = np.searchsorted(w.start, np.flatnonzero(_ENDS[p.data]).astype(w.start.dtype))
    first = np.unique(np.concatenate([w.of_text[:-1], behind]))
    return first[first < len(w.start)]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  # float32, 2 ** HASH_BITS

    def read(self, p: Piece) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words of a piece, first word and logit of each sentence."""
        w = words(p, NOT_WORD, lambda c: self.weights[features(c)].sum(1))
        first = sentences(p, w)
        return w, first, np.add.reduceat(w.extra, first, dtype=np.float64) + self.bias if len(first) else np.zeros(0)


def _rows(w: Words) -> np.ndarray:
    return np.zeros((0, 1 + len(PREFIXES)), np.int32) if w.extra is None else w.extra


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def noisy_or(z: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Document probabilities from sentence logits; starts: the documents' first sentences (n + 1 entries)."""
    total = np.concatenate([[0], np.cumsum(softplus(z))])
    return -np.expm1(-(total[starts[1:]] - total[starts[:-1]]))[:n]


def associated(both: np.ndarray, seen: np.ndarray, n1: int, n: int, least: float) -> np.ndarray:
    """Features whose presence in a document goes with its label, by the likelihood-ratio statistic.

    ``seen`` counts documents with each feature, ``both`` those of label 1; ``n1`` of all ``n`` documents have label 1.
    """
    total = np.zeros(len(seen))
    for k, row, column in ((both, seen, n1), (seen - both, seen, n - n1), (n1 - both, n - seen, n1), (n - n1 - seen + both, n - seen, n - n1)):
        expected = row * column / n
        total += 2 * np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.flatnonzero((seen >= 3) & (total >= least))


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4, least: float = 15.0) -> Model | None:
    """Adam on the likelihood of document labels through the noisy-or, over features associated with the label.

    Texts are read twice in pieces of bounded size, to choose features and to gather
    the chosen ones, so the features of all words are never held together.
    """
    if not len(labels) or labels.min() == labels.max():
        return None
    size = 1 << HASH_BITS
    both, seen = np.zeros(size), np.zeros(size)
    for p in pieces(texts, lower=True):
        w = words(p, NOT_WORD, features)
        x = _rows(w)
        of_text = np.repeat(np.arange(len(p)), np.diff(w.of_text))
        pair = np.unique((of_text.astype(np.int64) << HASH_BITS)[:, None] | x)
        feature, positive = pair & (size - 1), labels[p.first + (pair >> HASH_BITS)] == 1
        seen += np.bincount(feature, minlength=size)
        both += np.bincount(feature[positive], minlength=size)
    chosen = associated(both, seen, int(labels.sum()), len(labels), least)
    compact = np.full(size, -1)
    compact[chosen] = np.arange(len(chosen))
    feats, of_pair, docs, n_sent = [], [], [], 0
    for p in pieces(texts, lower=True):
        w = words(p, NOT_WORD, features)
        first = sentences(p, w)
        x = compact[_rows(w)]
        word, _ = np.nonzero(x >= 0)
        feats.append(x[x >= 0])
        of_pair.append(np.searchsorted(first, word, side="right") - 1 + n_sent)
        docs.append(np.searchsorted(first, w.of_text[:-1]) + n_sent)
        n_sent += len(first)
    starts = np.concatenate([*docs, [n_sent]])
    doc_of = np.repeat(np.arange(len(labels)), np.diff(starts))
    x, sent = np.concatenate(feats), np.concatenate(of_pair)
    params = np.concatenate([np.zeros(len(chosen)), [-5.0]])  # the bias is the last
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(sent, params[x], minlength=n_sent) + params[-1], -40, 40)
        s = np.bincount(doc_of, softplus(z), minlength=len(labels))
        # derivative of the loss by s: 1 for clean documents, -1 / (e^s - 1) for toxic ones
        by_s = np.where(labels == 1, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-6), 1.0)
        by_z = by_s[doc_of] / (1 + np.exp(-z))
        g = np.concatenate([np.bincount(x, by_z[sent], minlength=len(chosen)) / len(labels) + decay * params[:-1], [by_z.sum() / len(labels)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << HASH_BITS, dtype=np.float32)
    weights[chosen] = params[:-1]
    return Model(float(params[-1]), weights)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, id_col: str = "doc_id", text_col: str = "text", first: int = 1) -> pa.Table:
    """Texts and labels of at most ``max_docs`` labelled rows that are not held out: those of label ``first`` up to half, then others."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y is not null")
    known = known.filter(~is_held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("_id")
    mine = known.filter(F.col("y") == first).orderBy(order).limit(max_docs // 2)
    others = known.filter(F.col("y") != first).orderBy(order).limit(max_docs - max_docs // 2)
    chosen = F.broadcast(mine.union(others))  # max_docs rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text").between(1, MAX_TEXT_BYTES)).join(chosen, "_id")
    one = durable(rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).withColumns({"o": order, "size": F.octet_length("text")}))
    # max_docs rows at most, so one task can sum their sizes; rows beyond the bound of bytes are left out
    reached = F.sum("size").over(Window.orderBy("o", "_id").rowsBetween(Window.unboundedPreceding, 0))
    within = one.select("_id", reached.alias("reached")).filter(F.col("reached") <= MAX_TRAIN_BYTES).select("_id")
    return one.join(F.broadcast(within), "_id").orderBy("o", "_id").select("text", "y").toArrow()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_train_docs: int = 4000) -> Model | None:
    rows = training_rows(docs, labels, label, max_train_docs, id_col, text_col)
    return fit(rows.column("text").combine_chunks(), rows.column("y").to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", sentence_threshold: float = 0.3) -> DataFrame:
    """One row a document: id, score, worst_sentence (its probability), worst_start and worst_end (characters of
    the text from 0, the end exclusive; the first of equally bad sentences; null without one), n_toxic_sentences (of ``sentence_threshold`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id bigint, score double, worst_sentence double, worst_start bigint, worst_end bigint, n_toxic_sentences int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out, worst, begin, end, count = np.zeros(n), np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n, np.int32)
            if shared.value is not None:
                for p in pieces(batch.column(1), lower=True):
                    w, first, z = shared.value.read(p)
                    if not len(first):
                        continue
                    starts = np.searchsorted(first, w.of_text)
                    at = slice(p.first, p.first + len(p))
                    out[at] = noisy_or(z, starts, len(p))
                    last = np.concatenate([first[1:], [len(w.start)]]) - 1
                    toxic = np.concatenate([[0], np.cumsum(1 / (1 + np.exp(-z)) >= sentence_threshold)])
                    count[at] = toxic[starts[1:]] - toxic[starts[:-1]]
                    some = np.flatnonzero(starts[1:] > starts[:-1])
                    top = np.maximum.reduceat(z, starts[some])
                    doc_of = np.repeat(np.arange(len(some)), np.diff(np.concatenate([starts[some], [len(z)]])))
                    is_top = np.flatnonzero(z == top[doc_of])
                    pick = is_top[np.unique(doc_of[is_top], return_index=True)[1]]
                    worst[p.first + some] = 1 / (1 + np.exp(-top))
                    for k, a, b in zip(some.tolist(), w.start[first[pick]].tolist(), w.end[last[pick]].tolist(), strict=True):
                        begin[p.first + k] = characters(p.data[p.offsets[k] : a])
                        end[p.first + k] = begin[p.first + k] + characters(p.data[a:b])
            none = begin < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(out, 0, 1)), pa.array(worst), pa.array(begin, mask=none), pa.array(end, mask=none), pa.array(count)],
                ["id", "score", "worst_sentence", "worst_start", "worst_end", "n_toxic_sentences"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_train_docs: int = 4000) -> DataFrame:
    """``docs``, same columns, without the documents of ``threshold`` or more; scores are made in place, so no join is needed."""
    model = train(docs, labels, id_col, text_col, max_train_docs=max_train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        if shared.value is not None:
            for p in pieces(texts, lower=True):
                w, first, z = shared.value.read(p)
                if len(first):
                    out[p.first : p.first + len(p)] = noisy_or(z, np.searchsorted(first, w.of_text), len(p))
        return pa.array(out)

    return docs.filter(scores(F.col(text_col).cast("string")) < threshold)
