"""Toxicity scores from confirmed toxic examples and unlabelled text, by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwright.llm.common import mapped, written

#: Documents that a model is fitted on, about: confirmed toxic ones, and any others without their label.
POSITIVES, UNLABELLED = 6000, 20_000
#: Words that a model weighs, at most; each stands in so many of those documents at least, and its share among the toxic ones
#: is so many standard errors from that among all.
FEATURES, LEAST, SURE = 2048, 5, 4.0
#: Letters of a longer word's beginning, which is weighed beside the word, so that words made of the same stem count alike.
STEM = 4
#: Characters of the longest word that is weighed.
LONGEST = 64
#: The share of toxic documents where the labels do not tell it, and the range that it is kept in.
PRIOR, RANGE = 0.1, (0.001, 0.5)
#: Strengths of the penalty on weights: the one of least risk on a fifth of the sample is used.
PENALTIES = (1e-4, 2e-4, 4e-4)
#: Passes over the sample, and the optimiser's first step.
EPOCHS, STEP = 500, 0.05
#: Where the negative risk is below -SLACK, a step raises it by GAIN times its gradient in place of lowering the whole risk.
SLACK, GAIN = 0.0, 1.0
#: Characters whose words are searched at once.
PIECE = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The different words of a whole text, lower-cased: runs of letters. Beside longer ones stands ^ and their first STEM letters."""
    text, found, at = text or "", set(), 0
    while at < len(text):
        to = len(text) if len(text) - at <= PIECE else text.find(" ", at + PIECE)
        to = len(text) if to < 0 else to
        found.update(_WORD.findall(text[at:to].lower()))
        at = to
    found.update(["^" + w[:STEM] for w in found if len(w) > STEM])
    return found


@dataclass
class Sample:
    """Rows of feature numbers end to end (features, where each row begins and the end) with each row's number of toxic and of unlabelled documents."""

    features: np.ndarray
    bounds: np.ndarray
    toxic: np.ndarray
    unlabelled: np.ndarray

    def part(self, rows: np.ndarray) -> Sample:
        sizes = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.bounds[rows] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return Sample(self.features[at], bounds, self.toxic[rows], self.unlabelled[rows])

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.owner(), weights[self.features], len(self.toxic))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.toxic)), np.diff(self.bounds))


def _share(weight: np.ndarray) -> np.ndarray:
    return weight / max(weight.sum(), 1e-12)


def risks(sample: Sample, weights: np.ndarray, bias: float, prior: float) -> tuple[float, float]:
    """prior * R_P(+), the risk of toxic documents as such, and R_U(-) - prior * R_P(-), what the unlabelled ones leave for the others as such, by logistic loss.

    Their sum is the unbiased risk; the second is no less than 0 in expectation, so that a fit that lowers it further fits
    single documents.
    """
    z, p, u = sample.logits(weights, bias), _share(sample.toxic), _share(sample.unlabelled)
    high, low = np.logaddexp(0, -z), np.logaddexp(0, z)
    return float(prior * (p * high).sum()), float((u * low).sum() - prior * (p * low).sum())


def slope(sample: Sample, weights: np.ndarray, bias: float, prior: float) -> tuple[np.ndarray, float]:
    """The gradient (weights, bias) of the non-negative risk: of the whole where its second part is no less than -SLACK, else of GAIN times its negated second part alone."""
    z, p, u = sample.logits(weights, bias), _share(sample.toxic), _share(sample.unlabelled)
    chance = 0.5 * (1 + np.tanh(0.5 * z))
    negative = (u - prior * p) * chance
    if (u * np.logaddexp(0, z)).sum() - prior * (p * np.logaddexp(0, z)).sum() >= -SLACK:
        by_row = prior * p * (chance - 1) + negative
    else:
        by_row = -GAIN * negative
    return np.bincount(sample.features, by_row[sample.owner()], len(weights)), float(by_row.sum())


def descend(sample: Sample, size: int, prior: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS steps of Adam over the whole sample. Parts of it would often show a negative second risk by chance alone."""
    theta = np.zeros(size + 1)
    theta[size] = np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, EPOCHS + 1):
        by_weight, by_bias = slope(sample, theta[:size], theta[size], prior)
        g = np.append(by_weight + 2 * penalty * theta[:size], by_bias)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= STEP * (1 - (t - 1) / EPOCHS) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:size], float(theta[size])


@dataclass
class Toxicity:
    """Words with their weights, a bias, and what they were fitted with."""

    weights: dict[str, float]
    bias: float
    prior: float
    penalty: float

    def scores(self, texts: list[str | None]) -> list[float]:
        """Chances, from 0 to 1, that texts are toxic: the logistic function of the weights of their different words."""
        known = self.weights.keys()
        z = np.array([self.bias + sum(sorted(self.weights[w] for w in known & words_of(t))) for t in texts])
        return (0.5 * (1 + np.tanh(0.5 * z))).tolist()


def fit_sample(sample: Sample, vocabulary: list[str], prior: float) -> Toxicity:
    """A classifier for each penalty on four fifths of the sample; the one of least non-negative risk on the rest is fitted on all."""
    rest = np.arange(len(sample.toxic)) % 5 == 4
    best = PENALTIES[len(PENALTIES) // 2]
    if sample.toxic[rest].sum() > 0 and sample.unlabelled[rest].sum() > 0 and sample.toxic[~rest].sum() > 0:
        held, learned = sample.part(np.flatnonzero(rest)), sample.part(np.flatnonzero(~rest))
        found = []
        for penalty in PENALTIES:
            plus, minus = risks(held, *descend(learned, len(vocabulary), prior, penalty), prior)
            found.append((plus + max(minus, 0.0), penalty))
        best = min(found)[1]
    weights, bias = descend(sample, len(vocabulary), prior, best)
    return Toxicity(dict(zip(vocabulary, weights.tolist())), bias, prior, best)


def _words(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs with the different words of their texts, in order, in place of the texts."""
    return mapped(docs, text_col, {"words": "array<string>"}, lambda: lambda texts: [pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string()))], [c for c in docs.columns if c != text_col])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> Toxicity:
    """Fit on documents whose label is 1 and on documents of any label, or none, which is not looked at.

    About POSITIVES and UNLABELLED documents are drawn by a hash of id and text, so reruns agree. Words are counted over
    them by Spark; those that tell toxic documents from all, FEATURES at most, are weighed. What reaches the driver is
    bounded by these parameters. prior is the share of toxic documents among all: that of the labelled ones by default.
    Of several labels of an id the largest counts; rows without an id or a text, and labels that are null, teach nothing.
    Without a toxic document all scores are low.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("of_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = known.agg(F.count("*").alias("told"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    if prior is None:
        prior = n["toxic"] / n["told"] if n["told"] > n["toxic"] else PRIOR
    prior = min(max(prior, RANGE[0]), RANGE[1])
    if not n["toxic"]:
        return Toxicity({}, float(np.log(prior / (1 - prior))), prior, PENALTIES[0])

    def point(*of: str) -> Column:
        """From 0 to 1, by a hash."""
        return F.pmod(F.xxhash64(*of), F.lit(1_000_003)) / 1_000_003.0

    toxic = known.where("label = 1").where(point("of_id") * n["toxic"] < POSITIVES).select("of_id")  # about POSITIVES ids at most, so they can be broadcast
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    rows = rows.join(F.broadcast(toxic), F.col("id") == F.col("of_id"), "left").withColumn("toxic", F.col("of_id").isNotNull())
    size = rows.agg(F.count("*").alias("docs"), F.count_if("toxic").alias("toxic")).first()  # an id can stand in many rows
    drawn = rows.select("body", (F.col("toxic") & (point("id", "body") * size["toxic"] < POSITIVES)).cast("int").alias("p"), (point("body", "id") * size["docs"] < UNLABELLED).cast("int").alias("u")).where("p + u > 0")
    told = written(_words(drawn, "body"), "toxicity-sample")
    total = told.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("u"), F.lit(0)).alias("u")).first()
    by_word = told.select("p", "u", F.explode("words").alias("word")).where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    odds = [F.log((F.col(c) + 0.5) / (total[c] - F.col(c) + 0.5)) for c in ("p", "u")]
    sure = F.abs((odds[0] - odds[1]) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5)))
    picked = by_word.where(F.col("p") + F.col("u") >= LEAST).withColumn("sure", sure).where(F.col("sure") >= SURE).orderBy(F.desc("sure"), "word").limit(FEATURES)
    vocabulary = sorted(r["word"] for r in picked.select("word").collect())
    number = told.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number.value[w] for w in words if w in number.value) for words in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["features", "p", "u"])

    rows = told.select("words", "p", "u").mapInArrow(numbered, "features array<int>, p int, u int").groupBy("features").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect()
    rows = sorted(rows, key=lambda r: r["features"])
    rows = [rows[i] for i in np.random.default_rng(11).permutation(len(rows))]
    bounds = np.concatenate([[0], np.cumsum([len(r["features"]) for r in rows])]).astype(np.int64)
    features = np.fromiter((f for r in rows for f in r["features"]), np.int64, bounds[-1])
    return fit_sample(Sample(features, bounds, np.array([r["p"] for r in rows], float), np.array([r["u"] for r in rows], float)), vocabulary, prior)


def score(docs: DataFrame, model: Toxicity, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those to keep) with score (0 to 1, higher: toxic likelier) and predicted (1 from 0.5).

    The whole text is judged. Null texts and texts without words score by the bias alone; repeated rows are judged each; an
    empty table gives an empty one; columns of these names are replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        fitted = Toxicity(**told.value)

        def judge(texts: list[str | None]) -> list[pa.Array]:
            found = fitted.scores(texts)
            return [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]

        return judge

    return mapped(docs, text_col, {"score": "double", "predicted": "int"}, make, keep)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from documents whose fold is not 0 and judge all: doc_id, held_out, score and predicted. A null id is not held out and teaches nothing."""
    model = fit(docs.where(fold(F.col("doc_id")) != 0).select("doc_id", "text"), labels.where(fold(F.col("doc_id")) != 0).select("doc_id", "toxic"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
