"""Toxicity grades by cumulative-link (proportional odds) regression on sparse text features.

A text's features are the hashed words that it has, and the beginnings of words (stems, which
inflected or disguised forms share). One weight vector serves all ordered
thresholds: P(grade > k) = sigmoid(score - threshold_k). The expected severity is the sum of
these probabilities over k. Features that go with the grades by more than chance are fitted by
accelerated proximal gradient steps with an L1 penalty; all others have exactly no weight, so
the length of a text alone moves nothing.

Grades come from labels: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a text of
low quality. The model is fitted on at most FIT_ROWS labelled documents, picked by hash; all
documents are scored.

Defined results: a null or empty text has no features and gets the severity of the thresholds
alone; documents with contradicting labels count with the higher grade; null labels are left
out; without labelled documents every severity is 0; repeated rows get equal results; long
texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read
from .words import Words, mix, slices

#: Most labelled documents that a model is fitted on; their features are what the driver holds.
FIT_ROWS = 12_000
FEATURES = 1 << 20
#: Besides whole words, their first so many bytes: stems, whatever ending they have.
HEADS = (4, 5)
#: Features in fewer fitted documents than this, or whose part in the grades could be chance
#: (so many standard errors), have no weight.
LEAST_DOCS = 5
LEAST_Z = 5.0
L1 = 1e-4
STEPS = 400
#: Least probability of a grade above 0 at which a text is called toxic: to let one pass costs
#: more than to look at one in vain.
TOXIC = 0.2


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct features of all texts, in order of texts; how many each text has)."""
    words = Words(texts, HEADS)
    doc = np.tile(np.repeat(np.arange(len(words)), np.diff(words.first)), 1 + len(HEADS))
    salted = [words.hashes, *(mix(h + np.uint64(n)) for n, h in zip(HEADS, words.heads, strict=True))]
    every = np.unique(doc << 20 | (np.concatenate(salted) & np.uint64(FEATURES - 1)).astype(np.int64))
    return every & (FEATURES - 1), np.bincount(every >> 20, minlength=len(words))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(counts)), counts), self.weights[held], len(counts))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a row for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -500, 500)))


def fit(held: np.ndarray, counts: np.ndarray, grades: np.ndarray, levels: int = 3, l1: float = L1, steps: int = STEPS) -> Model:
    """The maximum a posteriori weights and ordered thresholds."""
    n, weights = len(grades), np.zeros(FEATURES)
    if not n:
        return Model(weights, np.full(levels - 1, np.inf))
    doc = np.repeat(np.arange(n), counts)
    used = np.flatnonzero(screen(held, doc, grades, levels) >= LEAST_Z)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    own = place[held]
    doc, own = doc[own >= 0], own[own >= 0]
    share = np.array([(np.sum(grades > k) + 0.5) / (n + 1) for k in range(levels - 1)])
    cuts, w = np.log(1 / share - 1), np.zeros(len(used))
    # A bound on the curvature along each weight: its documents, times the features they have.
    bound = np.bincount(own, (np.bincount(doc, minlength=n) + 1.0)[doc], len(used)) / (4 * n) + 1e-9
    ahead, ahead_cuts, momentum = w, cuts, 1.0
    for _ in range(steps):
        g, g_cuts = gradient(ahead, ahead_cuts, own, doc, grades, levels)
        step = ahead - g / bound
        now = np.sign(step) * np.maximum(np.abs(step) - l1 / bound, 0)
        now_cuts = np.maximum.accumulate(ahead_cuts - g_cuts)  # thresholds stay in order
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        push = (momentum - 1) / faster
        ahead, ahead_cuts = now + push * (now - w), np.maximum.accumulate(now_cuts + push * (now_cuts - cuts))
        w, cuts, momentum = now, now_cuts, faster
    weights[used] = w
    return Model(weights, cuts)


def screen(held: np.ndarray, doc: np.ndarray, grades: np.ndarray, levels: int) -> np.ndarray:
    """How far from chance each feature goes with any grade above k: the greatest |z|."""
    out, all_docs, n = np.zeros(FEATURES), np.bincount(held, minlength=FEATURES), len(grades)
    for k in range(levels - 1):
        high = grades > k
        n1 = int(high.sum())
        if not 0 < n1 < n:
            continue
        ones = np.bincount(held, high[doc], FEATURES)
        p = all_docs / n
        z = (ones / n1 - (all_docs - ones) / (n - n1)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
        out = np.maximum(out, np.where(all_docs >= LEAST_DOCS, np.abs(z), 0))
    return out


def gradient(w: np.ndarray, cuts: np.ndarray, own: np.ndarray, doc: np.ndarray, grades: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood, by weights and by thresholds."""
    n, s = len(grades), np.bincount(doc, w[own], len(grades))
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    below = 1 / (1 + np.exp(-np.clip(edges[grades + 1] - s, -500, 500)))
    under = 1 / (1 + np.exp(-np.clip(edges[grades] - s, -500, 500)))
    p = np.maximum(below - under, 1e-9)
    up, down = below * (1 - below) / p, under * (1 - under) / p
    by_cut = [(down[grades == k + 1].sum() - up[grades == k].sum()) / n for k in range(levels - 1)]
    return np.bincount(own, (up - down)[doc], len(w)) / n, np.array(by_cut)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labelled documents."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 1), 1).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, text: str = "text") -> Model:
    picked = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), F.col("_doc") == F.col("doc_id")).select("text", F.col("grade").cast("long"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(0)):
                held, counts = features(batch.column(0)[low:high])
                ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(1)[low:high], pa.ListArray.from_arrays(ends, pa.array(held, pa.int32()))], ["grade", "held"])

    table = rows.mapInArrow(sparse, "grade long, held array<int>").toArrow()
    lists = table["held"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    return fit(lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()), table["grade"].to_numpy())


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (the likeliest) and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                above = own.above(own.scores(*features(batch.column(1)[low:high])))
                each = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
                columns = [pa.array(above.sum(1).round(6)), pa.array(above[:, 0].round(6)), pa.array(each.argmax(1)), pa.array(above[:, 0] >= TOXIC)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *columns], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(predict, "doc_id long, severity double, p_toxic double, grade long, toxic boolean")


def op5_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op5_severity": op5_severity}
ORACLE_SQL: dict[str, str] = {}
