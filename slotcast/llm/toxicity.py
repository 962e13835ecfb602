"""Toxicity from subword-bag embeddings and a linear softmax, trained together in numpy.

A word is the mean of the embeddings of its character n-grams and of itself, a passage of
``PASSAGE`` words is the mean of its distinct words, and a linear softmax scores it.  A text is as toxic as
its worst passage.  Misspelt words share most n-grams with words seen in training.

The model is fitted on the driver on a bounded sample of labelled rows (``Training``); the sample
is drawn by class, and a calibration on spared texts sets scores back to the true class shares.  Scoring needs only
one number per n-gram bucket, since the softmax is linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .common import CHUNK_BYTES, Spans, Texts, byte_class, mix, slices, word_bounds

PASSAGE = 50
#: Words without meaning that short passages are filled up with.
PADDING = 10
GRAMS = (3, 4, 5, 6)
THRESHOLD = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART_OF_WORD = byte_class(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample and settings of the fit."""

    toxic_rows: int = 1000
    other_rows: int = 2000
    max_bytes: int = 16_384  # longer texts are not trained on
    buckets: int = 1 << 20
    support: int = 4  # n-grams of fewer texts of the sample keep a weight of zero
    size: int = 4
    epochs: int = 6
    batch: int = 128
    least_steps: int = 400  # small samples are gone through more often
    rate: float = 0.1
    scale: float = 20.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Contribution of each bucket to the log-odds of a passage, and how texts follow from them."""

    weight: np.ndarray
    prior: float  # chance of a text without words
    per_log_passages: float = 0.0  # taken off the worst passage for each log of their number
    knots: np.ndarray | None = None  # rising log-odds and the chances found there
    chances: np.ndarray | None = None

    def chance(self, worst: np.ndarray, passages: np.ndarray) -> np.ndarray:
        out = np.full(len(worst), self.prior)
        some = passages > 0
        if self.knots is not None:
            odds = worst[some] - self.per_log_passages * np.log(passages[some])
            # a small share of the plain odds keeps the order where the fitted steps are flat
            plain = 1 / (1 + np.exp(-np.clip(odds / 10, -30, 30)))
            out[some] = 0.98 * np.interp(odds, self.knots, self.chances) + 0.02 * plain
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text, modulo 4, is 2; null ids train."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


class Bag:
    """Words of texts, their n-gram buckets and their passages."""

    def __init__(self, texts: Texts, buckets: int):
        data = _LOWER[texts.data]
        starts, ends = word_bounds(~_PART_OF_WORD[data], texts.borders)
        hashes = np.empty(len(starts), np.uint64)  # block by block, since prefix sums take room
        begin = 0
        while begin < len(starts):
            end = int(np.searchsorted(ends, starts[begin] + CHUNK_BYTES, "right"))
            end = max(end, begin + 1)
            low = starts[begin]
            spans = Spans(data[low : ends[end - 1]])
            hashes[begin:end] = spans.hash(starts[begin:end] - low, ends[begin:end] - low)
            begin = end
        _, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        # all distinct words one after another, each between two marks
        borders = np.concatenate([[0], np.cumsum(lengths + 2)])
        marked = np.full(borders[-1], ord("<"), np.uint8)
        marked[borders[1:] - 1] = ord(">")
        inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        marked[np.repeat(borders[:-1] + 1, lengths) + inner] = data[np.repeat(starts[first], lengths) + inner]
        spans = Spans(marked)
        end_of = np.repeat(borders[1:], lengths + 2)
        word_of = np.repeat(np.arange(len(lengths)), lengths + 2)
        owners, found = [np.arange(len(lengths))], [spans.hash(borders[:-1], borders[1:])]
        for n in GRAMS:
            at = np.flatnonzero(np.arange(len(marked)) + n <= end_of)
            owners.append(word_of[at])
            found.append(spans.hash(at, at + n))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.gram_word = owner[order]
        self.gram = (mix(np.concatenate(found))[order] % np.uint64(buckets)).astype(np.int64)
        self.n_grams = np.bincount(self.gram_word, minlength=len(lengths))
        # passages: every PASSAGE words of a text; a text without words has none
        self.borders = np.searchsorted(starts, texts.borders)
        n_words = np.diff(self.borders)
        text = np.repeat(np.arange(texts.n), n_words)
        place = np.arange(len(starts)) - np.repeat(self.borders[:-1], n_words)
        new = place % PASSAGE == 0
        # a word that a passage repeats counts once
        pairs = np.unique((np.cumsum(new) - 1) * max(len(first), 1) + self.word)
        self.passage, self.word = pairs // max(len(first), 1), pairs % max(len(first), 1)
        self.passage_text = text[new]
        self.passage_size = np.bincount(self.passage, minlength=len(self.passage_text))

    def worst(self, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Highest log-odds over the passages of each of n texts, and the number of passages."""
        words = np.bincount(self.gram_word, weight[self.gram], len(self.n_grams)) / self.n_grams
        sums = np.bincount(self.passage, words[self.word], len(self.passage_text))
        out = np.full(n, -np.inf)
        np.maximum.at(out, self.passage_text, sums / (self.passage_size + PADDING))
        return out, np.bincount(self.passage_text, minlength=n)


def _calibrate(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic fit by Newton steps with a small ridge."""
    beta = np.zeros(features.shape[1])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        curve = (features * (weight * chance * (1 - chance))[:, None]).T @ features
        slope = features.T @ (weight * (label - chance)) - 0.1 * beta
        step = np.linalg.solve(curve + 0.1 * np.eye(len(beta)), slope)
        beta += np.clip(step, -1, 1)
    return beta


def _rising(odds: np.ndarray, label: np.ndarray, weight: np.ndarray, prior: float):
    """Isotonic regression: log-odds of the pooled blocks and their chance, smoothed by one text."""
    blocks: list[list[float]] = []  # weight, weighted labels, weighted odds
    for i in np.argsort(odds, kind="stable"):
        blocks.append([weight[i], weight[i] * label[i], weight[i] * odds[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    w, y, z = np.array(blocks).T
    return z / w, np.maximum.accumulate((y + prior) / (w + 1))


def fit(texts: Texts, toxic: np.ndarray, toxic_share: float, how: Training = Training()) -> Model:
    """Train embeddings and softmax on all passages of the texts, each with its text's label.

    Minibatches of passages with Adagrad steps: what many passages share gains most, and rare
    n-grams move little, so wrong labels are not learnt by heart.  Every fourth text stays out of
    the training and serves to calibrate the scores of texts.
    """
    rng = np.random.default_rng(how.seed)
    bag = Bag(texts, how.buckets)
    spared = np.arange(texts.n) % 4 == 3
    train = np.flatnonzero(~spared[bag.passage_text])
    label = toxic[bag.passage_text].astype(int)
    true = min(max(toxic_share, 1e-3), 1 - 1e-3)
    if not len(train) or not label[train].any() or label[train].all():
        return Model(np.zeros(how.buckets, np.float32), true)
    # only n-grams with support are trained; the words' sizes still count all of theirs
    n_words = len(bag.n_grams)
    texts_of = np.unique(bag.passage_text[bag.passage] * n_words + bag.word) % n_words
    support = np.bincount(bag.gram, np.bincount(texts_of, minlength=n_words)[bag.gram_word], how.buckets)
    trained = np.flatnonzero(support >= how.support)
    dense = np.full(how.buckets, -1)
    dense[trained] = np.arange(len(trained))
    gram = dense[bag.gram]
    known = gram >= 0
    gram, gram_word = gram[known], bag.gram_word[known]
    word_first = np.searchsorted(gram_word, np.arange(n_words + 1))
    passage_first = np.searchsorted(bag.passage, np.arange(len(label) + 1))
    embedding = rng.standard_normal((len(trained), how.size)) * 0.05
    softmax = rng.standard_normal((how.size, 2)) * 0.3
    sampled = label[train].mean()
    bias = np.array([0.0, np.log(sampled / (1 - sampled))])
    slopes = [np.full(v.shape, 1e-8) for v in (embedding, softmax, bias)]
    per_epoch = -(-len(train) // how.batch)
    for _ in range(max(how.epochs, -(-how.least_steps // per_epoch))):
        order = rng.permutation(train)
        for begin in range(0, len(order), how.batch):
            chosen = order[begin : begin + how.batch]
            sizes = bag.passage_size[chosen]
            row = np.repeat(np.arange(len(chosen)), sizes)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            word = bag.word[np.repeat(passage_first[chosen], sizes) + inner]
            counts = word_first[word + 1] - word_first[word]
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            used = gram[np.repeat(word_first[word], counts) + inner]
            share = np.repeat(how.scale / bag.n_grams[word] / (sizes[row] + PADDING), counts)
            row = np.repeat(row, counts)
            hidden = np.stack(
                [np.bincount(row, embedding[used, k] * share, len(chosen)) for k in range(how.size)], axis=1
            )
            logits = hidden @ softmax + bias
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
            wrong = chance - np.eye(2)[label[chosen]]
            back = wrong @ softmax.T
            grads = (
                np.stack([np.bincount(used, back[row, k] * share, len(trained)) for k in range(how.size)], axis=1),
                hidden.T @ wrong,
                wrong.sum(axis=0),
            )
            for value, grad, slope in zip((embedding, softmax, bias), grads, slopes):
                slope += grad * grad
                value -= how.rate * grad / np.sqrt(slope)
    weight = np.zeros(how.buckets, np.float32)
    weight[trained] = embedding @ (softmax[:, 1] - softmax[:, 0]) * how.scale
    worst, passages = bag.worst(weight, texts.n)
    test = np.flatnonzero(spared & (passages > 0))
    features = np.stack([worst[test], np.log(passages[test]), np.ones(len(test))], axis=1)
    balance = np.where(toxic[test], true / max(toxic.mean(), 1e-9), (1 - true) / max(1 - toxic.mean(), 1e-9))
    if not toxic[test].any() or toxic[test].all():
        return Model(weight, true)
    slope, share, _ = _calibrate(features, toxic[test].astype(float), balance)
    lost = max(0.0, -share / slope) if slope > 0 else 0.0
    odds = worst[test] - lost * np.log(passages[test])
    return Model(weight, true, float(lost), *_rising(odds, toxic[test].astype(float), balance, true))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", how: Training = Training(),
) -> Model:
    """Fit on labelled rows that are not held out; the sample is bounded by ``how``.

    Rows are taken in the order of a hash of their id.  Null ids, labels and texts do not train;
    of several labels for an id the highest counts.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id"))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    chosen = [
        known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
        for y, n in ((1, how.toxic_rows), (0, how.other_rows))
    ]
    share = known.agg(F.avg("_y")).first()[0] or 0.0
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most toxic_rows + other_rows ids
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .where(F.octet_length("_t") <= how.max_bytes).join(sample, "_id")
        .select("_id", "_t", "_y").toArrow().combine_chunks().sort_by([("_id", "ascending"), ("_t", "ascending")])
    )
    text = rows.column("_t").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    return fit(Texts(text), rows.column("_y").to_numpy().astype(bool), share, how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text and the decision at ``THRESHOLD``; null counts as empty."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    id_type = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(2)
            parts = [
                own.chance(*Bag(Texts(column.slice(a, b - a)), len(own.weight)).worst(own.weight, b - a))
                for a, b in slices(column)
            ]
            chance = np.concatenate(parts or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chance),
                 pa.array((chance >= THRESHOLD).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"],
            )

    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(
        apply, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int"
    )
