"""Toxicity by a counterfactual-regularised linear classifier.

A text is the set of its words and word beginnings. Besides the usual loss on
labelled texts, training swaps the identity terms of a text for others of the
same list and penalises the squared change of the log-odds, so a mention of a
group as such moves the score little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.words import Words, chunks, letters, mix
from tillbook.session import cut_lineage

# The classifier is fitted on at most so many labelled rows, the first by a hash of the id.
SAMPLE_ROWS = 12_000
# Features it may use, the fewest sampled texts that a feature must be in, and its least log-likelihood ratio:
# of a hundred thousand features that say nothing, about one reaches it.
MOST_FEATURES = 1_500
LEAST_TEXTS = 3
LEAST_GAIN = 10.0
# Lengths of the word beginnings that count as features, in bytes.
BEGINNINGS = (4, 5)
HOLD_OUT = 5

# Terms that name groups neutrally; each list is swapped within itself.
IDENTITY_TERMS = (
    "women men girls boys mothers fathers gay straight lesbian bisexual transgender".split(),
    "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists".split(),
    "black white asian african european latino arab indigenous immigrant immigrants refugee refugees".split(),
    "disabled deaf blind elderly old young".split(),
    "frauen männer mädchen jungen muslime christen juden schwule lesben ausländer flüchtlinge behinderte".split(),
    "femmes hommes filles garçons musulmans chrétiens juifs homosexuels lesbiennes étrangers réfugiés handicapés".split(),
    "mujeres hombres niñas niños musulmanes cristianos judíos homosexuales lesbianas extranjeros refugiados".split(),
)


@dataclass(frozen=True)
class Model:
    """Log-odds of a text: bias plus the weights of the features it has."""

    features: np.ndarray  # sorted 64-bit numbers
    weights: np.ndarray
    bias: float


def _word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every word and word beginning; repeats included."""
    found = [(words.text, words.hashes)]
    for size in BEGINNINGS:
        long = np.flatnonzero(words.lengths > size)
        found.append((words.text[long], mix(words.rolling.at(words.starts[long], size) + np.uint64(size))))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    return text[new], feature[new]


def _of_terms(terms: list[str]) -> list[np.ndarray]:
    """The features of each term, as its word would have them."""
    words = Words(pa.array(terms, pa.string()), letters(), lower=True)
    text, feature = _word_features(words)
    return [np.unique(feature[text == i]) for i in range(len(terms))]


def texts_features(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For each run of texts: (rows, text numbers, distinct features)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for part in chunks(sizes):
        words = Words(texts.slice(part.start, part.stop - part.start), letters(), lower=True)
        yield part, *_distinct(*_word_features(words))


class Lookup:
    """Positions of features in a sorted list; a table of low bits turns most others away."""

    BITS = 20

    def __init__(self, features: np.ndarray):
        self.features = features
        self.mask = np.uint64((1 << self.BITS) - 1)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[features & self.mask] = True

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in wanted, positions in the list) of those in the list."""
        at = np.flatnonzero(self.table[wanted & self.mask])
        if not len(self.features):
            return at[:0], at[:0]
        own = np.minimum(np.searchsorted(self.features, wanted[at]), len(self.features) - 1)
        same = self.features[own] == wanted[at]
        return at[same], own[same]


def score_of(model: Model):
    """Column function: the score of a text, 0 to 1; a null text scores like an empty one."""
    lookup = Lookup(model.features)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        odds = np.full(len(texts), model.bias)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for part in chunks(sizes):
            words = Words(texts.slice(part.start, part.stop - part.start), letters(), lower=True)
            text, feature = _word_features(words)
            at, own = lookup(feature)
            pairs = np.unique(text[at] * len(model.features) + own) if len(at) else np.zeros(0, np.int64)
            if len(pairs):
                gained = np.bincount(pairs // len(model.features), model.weights[pairs % len(model.features)], part.stop - part.start)
                odds[part] += gained
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))))

    return score


def held_out(id):
    """Condition: rows never learned from. A null id is not held out; it has no label either."""
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "UTF-8")) % HOLD_OUT == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str) -> DataFrame:
    """(_text, _label) of at most ``SAMPLE_ROWS`` labelled rows outside the held-out part."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.dropna().where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    # the sample is bounded, so it may be sent to every task
    return rows.join(F.broadcast(known), "_id").select("_text", "_label")


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits the classifier; without labelled rows, or with one class only, the bias alone is fitted.

    Features are counted on the executors; only those chosen come to the driver.
    """
    spark = docs.sparkSession

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, feature in texts_features(batch.column(0)):
                begins = np.searchsorted(at, np.arange(part.stop - part.start + 1))
                lists = pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(feature.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [lists.cast(pa.list_(pa.int64())), batch.column(1).slice(part.start, part.stop - part.start)], ["features", "label"])

    rows = cut_lineage(sample(docs, labels, id=id, text=text, label=label).mapInArrow(features, "features array<long>, label int"))
    positive, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("label")).first()
    prior = float(np.log((positive + 0.5) / (total - positive + 1.0)))
    if not 0 < positive < total:
        return Model(np.zeros(0, np.uint64), np.zeros(0), prior)

    counts = (
        rows.select(F.explode("features").alias("feature"), "label").groupBy("feature")
        .agg(F.sum("label").cast("double").alias("p"), F.count("label").cast("double").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    )
    p, n = F.col("p"), F.col("n")
    share = positive / total
    gain = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    chosen = counts.select("feature", (gain(p, n * share) + gain(n - p, n * (1 - share))).alias("gain"))
    chosen = chosen.where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(MOST_FEATURES).toPandas()["feature"].to_numpy(np.int64).view(np.uint64)

    groups = [_of_terms(terms) for terms in IDENTITY_TERMS]
    terms = np.concatenate([f for group in groups for f in group])
    kept = np.unique(np.concatenate([chosen, terms]))
    lookup = Lookup(kept)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            own = [lookup(lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64))[1].astype(np.int32).tolist() for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], ["features", "label"])

    small = rows.mapInArrow(narrowed, "features array<int>, label int").toPandas()
    texts = [np.asarray(x, np.int64) for x in small["features"]]
    swapped = _swapped(texts, kept, groups)
    weights, bias = _train(texts, swapped, small["label"].to_numpy(np.float64), len(kept), prior)
    return Model(kept, weights, bias)


def _swapped(texts: list[np.ndarray], kept: np.ndarray, groups: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Each text with its identity terms replaced by the next term of their list."""
    place = {int(f): i for i, f in enumerate(kept)}
    turn: dict[int, tuple[list[int], list[int]]] = {}
    for group in groups:
        for i, own in enumerate(group):
            other = group[(i + 1) % len(group)]
            word = max(own, key=lambda f: sum(f in g for g in group) == 1)  # a feature of this term alone
            turn[place[int(word)]] = [place[int(f)] for f in own], [place[int(f)] for f in other]
    out = []
    for text in texts:
        hits = [turn[f] for f in text.tolist() if f in turn]
        if hits:
            gone = {f for own, _ in hits for f in own}
            text = np.array(sorted((set(text.tolist()) - gone) | {f for _, other in hits for f in other}), np.int64)
        out.append(text)
    return out


def _train(texts, swapped, labels, size: int, prior: float, *, steps: int = 400, penalty: float = 4.0, decay: float = 2e-4):
    """Adam on the mean log loss + penalty * mean squared change of the log-odds + decay * squared weights."""

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)

    row, col = flat(texts)
    moved = [i for i, (a, b) in enumerate(zip(texts, swapped)) if a is not b]
    mine, other = flat([texts[i] for i in moved]), flat([swapped[i] for i in moved])
    # the rare class counts more, so that 0.5 is a fair threshold
    rate = labels.mean()
    importance = np.where(labels > 0, np.sqrt((1 - rate) / rate), 1.0)
    importance /= importance.sum()
    weights, bias = np.zeros(size), prior
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        odds = bias + np.bincount(row, weights[col], len(texts))
        error = importance * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - labels)
        grad = np.append(np.bincount(col, error[row], size) + 2 * decay * weights, error.sum())
        if moved:
            change = np.bincount(mine[0], weights[mine[1]], len(moved)) - np.bincount(other[0], weights[other[1]], len(moved))
            change *= 2 * penalty / len(moved)
            grad[:-1] += np.bincount(mine[1], change[mine[0]], size) - np.bincount(other[1], change[other[0]], size)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def score_documents(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``.

    The score depends on the text alone: empty and null texts score as the bias,
    equal texts equally, of any length. Repeated label rows of an id count once,
    toxic if any says so; label rows with nulls are not used. Other columns are
    ignored. Without any labelled rows every text has the same score.
    """
    model = fit(docs, labels, id=id, text=text, label=label)
    rows = docs.select(F.col(id).alias(id), score_of(model)(F.col(text)).alias("score"))
    return rows.select(id, held_out(F.col(id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
