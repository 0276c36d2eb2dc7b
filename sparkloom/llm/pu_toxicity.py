"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic model learns from confirmed toxic texts and unlabelled ones. The risk is corrected by the class prior:
prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]); where the second part turns negative, the step
undoes it instead, which keeps a flexible model from overfitting the positives. Features say which words, word
beginnings and letter groups a text holds, hashed to a fixed space, whatever their number, order or place.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, row_key, table

#: Hashed features.
SPACE = 1 << 18
#: Bounds of the training sample, in rows: confirmed positives, unlabelled texts.
POSITIVES = 2000
UNLABELLED = 6000
#: Features that get a weight.
TELLING = 4096
#: The prior's factor in the risk: a little more than one trades few false positives for fewer misses.
CAUTION = 1.15
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
#: Different words a task remembers the features of.
CACHED_WORDS = 300_000
WORD = re.compile(r"\w+")


class WordFeatures(dict):
    """The features of words: the word itself, its first 4 and 5 letters, its groups of 4 letters."""

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = np.array(self.of(word), np.int32)
        return value

    @staticmethod
    def of(word):
        names = {"=" + word, "^" + word[:4], "^" + word[:5], *(word[i : i + 4] for i in range(len(word) - 3))}
        return [zlib.crc32(n.encode()) % SPACE for n in names]


def features_of(text: str | None, known: WordFeatures) -> np.ndarray:
    """The sorted distinct features of a text; none for null or without words."""
    words = set(WORD.findall((text or "").lower()))
    return np.unique(np.concatenate([known[w] for w in words])) if words else np.empty(0, np.int32)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def with_features(docs: DataFrame) -> DataFrame:
    """docs(positive, text) as positive, features."""

    def run(batches):
        known = WordFeatures()
        for batch in batches:
            values = [features_of(t, known) for t in batch.column("text").to_pylist()]
            offsets = pa.array(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32))
            flat = np.concatenate(values) if values else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["positive", "features"])

    return arrow_map(docs.select("positive", "text"), run, "positive boolean, features array<int>")


def bounded(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """The `bound` rows of rows(doc_id, ...) whose ids have the smallest hashes; all where there are no more.

    Few more than that are sorted: those whose hash is below what gives bound rows and a fifth on average.
    """
    n = rows.count()
    part = max(1, min(1_000_000, round(1_200_000 * bound / n) + 1)) if n else 1_000_000
    few = rows.withColumn("__hash", F.xxhash64("doc_id", F.lit(seed))).filter(F.pmod("__hash", F.lit(1_000_000)) < part)
    return few.orderBy("__hash", *rows.columns).limit(bound).drop("__hash")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(positive: np.ndarray, unlabelled: np.ndarray, n: tuple[int, int], most: int = TELLING) -> np.ndarray:
    """Features clearly more frequent among n[0] positives than among n[1] unlabelled texts, the clearest `most`.

    positive, unlabelled: how many texts have each feature.
    """
    share = (positive + unlabelled + 0.5) / (n[0] + n[1] + 1)
    z = (positive / n[0] - unlabelled / n[1]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    z[positive < 2] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] >= 4.5])


def margins(rows: list[np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The margin of each row of features, and for each feature its row and itself."""
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    return np.bincount(at, w[flat], len(rows)) + w[-1], at, flat


def risk(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, w: np.ndarray) -> tuple[float, float]:
    """The two parts of the risk with sigmoid loss: prior * E_P[loss(+)], and E_U[loss(-)] - prior * E_P[loss(-)]."""
    sp, su = sigmoid(margins(positive, w)[0]), sigmoid(margins(unlabelled, w)[0])
    return prior * (1 - sp).mean(), su.mean() - prior * sp.mean()


def step_direction(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, w: np.ndarray) -> np.ndarray:
    """The gradient of the whole risk, or that of the second part's negative where the second part is negative."""
    (gp, ap, fp), (gu, au, fu) = margins(positive, w), margins(unlabelled, w)
    sp, su = sigmoid(gp), sigmoid(gu)
    slope_p, slope_u = prior * sp * (1 - sp) / len(gp), su * (1 - su) / len(gu)
    # first part: -slope_p; second part: slope_u and -slope_p
    dp, du = (-2 * slope_p, slope_u) if su.mean() - prior * sp.mean() >= 0 else (slope_p, -slope_u)
    grad = np.bincount(np.concatenate([fp, fu]), np.concatenate([dp[ap], du[au]]), len(w))
    grad[-1] += dp.sum() + du.sum()
    return grad


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, space: int = SPACE, epochs: int = 200, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights of the features and, last, the bias, by Adam on the non-negative PU risk with sigmoid loss."""
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(space + 1), np.zeros(space + 1), np.zeros(space + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, 1 + max(1500, epochs * max(1, len(unlabelled) // (3 * batch)))):
        pick = rng.integers(0, len(positive), batch), rng.integers(0, len(unlabelled), 3 * batch)
        grad = step_direction(*([rows[i] for i in k] for rows, k in zip((positive, unlabelled), pick, strict=True)), prior, w)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] *= 1 - decay
    return w


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict[int, float]:
    """The weights of the telling features, and of -1 the bias, from docs(doc_id, text) and labels(doc_id, toxic).

    Held-out rows are not read. At most `positives` confirmed texts and `unlabelled` texts of all kinds, labelled or not,
    come to the driver, as hashed features. The class prior is the share of toxic rows among the labels learnt from, times CAUTION.
    Without any positive or any text every score is 0.5 times that prior.
    """
    known = labels.filter("toxic is not null").filter(~held_out()).select("doc_id", "toxic")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(0.9, max(0.005, CAUTION * toxic / n)) if n else 0.05
    texts = docs.select("doc_id", "text").filter(~F.coalesce(held_out(), F.lit(False)))
    confirmed = bounded(texts.join(bounded(known.filter("toxic = 1").select("doc_id").distinct(), positives, 1), "doc_id"), positives, 1)
    rows = confirmed.withColumn("positive", F.lit(True)).unionAll(bounded(texts, unlabelled, 2).withColumn("positive", F.lit(False)))
    rows = with_features(rows.select("positive", "text")).toArrow()
    counts, n = {True: np.zeros(SPACE, np.int64), False: np.zeros(SPACE, np.int64)}, {True: 0, False: 0}
    parts = rows.to_batches(max_chunksize=128)
    for part in parts:  # a part at a time, so that the driver holds the sample once
        for p, f in zip(part["positive"].to_pylist(), part["features"], strict=True):
            counts[p][f.values.to_numpy()] += 1
            n[p] += 1
    if not n[True] or not n[False]:
        return {-1: float(np.log(0.5 * prior / (1 - 0.5 * prior)))}
    keep = telling(counts[True], counts[False], (n[True], n[False]))
    place = np.full(SPACE, -1, np.int32)
    place[keep] = np.arange(len(keep))
    sides: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for part in parts:
        for p, f in zip(part["positive"].to_pylist(), part["features"], strict=True):
            x = place[f.values.to_numpy()]
            sides[p].append(x[x >= 0])
    del rows, parts, part, f, x
    pa.default_memory_pool().release_unused()
    w = fit_nnpu(sides[True], sides[False], prior, len(keep)).tolist()
    return {**dict(zip(keep.tolist(), w, strict=False)), -1: w[-1]}


class TellingFeatures(dict):
    """The features of words that have a weight; most words have none."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights, self.features = weights, WordFeatures()

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = frozenset(x for x in self.features.of(word) if x in self.weights)
        return value

    def score(self, text: str | None) -> float:
        held = frozenset().union(*map(self.__getitem__, {*WORD.findall((text or "").lower())}))
        return float(sigmoid(np.float64(sum(self.weights[x] for x in sorted(held)) + self.weights[-1])))


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic): computed from the text column alone, whatever the others."""
    name = "score"
    if name in docs.columns:
        docs = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        known = TellingFeatures(weights)
        for batch in batches:
            values = [known.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return arrow_map(docs, run, f"{schema}, {name} double")


def pu_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    Labels are learnt only from rows that are not held out (crc32 of the id as text, modulo 4, is 2). A score depends on
    the text alone: null, empty and wordless texts get the bias's score, repeated rows equal ones, ids and other
    columns play no part. A null doc_id isn't held out. Labels without a toxic row or text give constant scores, no
    documents no rows; whether all or few documents have labels makes no difference to the unlabelled sample.
    """
    weights = train(docs, labels, positives, unlabelled)
    out = score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return pu_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score reaches the threshold go; the others stay as they are."""
    weights = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs.withColumn("__kept", F.col("score")) if "score" in docs.columns else docs, weights)
    kept = out.filter(F.col("score") < THRESHOLD)
    return (kept.drop("score").withColumnRenamed("__kept", "score") if "score" in docs.columns else kept).select(*docs.columns)
