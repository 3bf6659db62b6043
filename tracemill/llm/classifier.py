"""Quality scores by regularised quadratic discriminant analysis of document statistics.

A document becomes a short vector of transformed counts of its whole text. Each class has a mean
and a covariance from the labelled rows; the covariance is shrunk towards the pooled one and its
diagonal, so a class with few rows or constant statistics still has a Cholesky factor. The factors
are kept with the model: a score is the logistic of the difference of two log densities, each a
Mahalanobis distance through a triangular factor, a log determinant and a log prior.

Moments are summed in Spark; the driver sees d + d * d sums per class, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.line_rules import _repeats
from tracemill.llm.words import distinct, portions, word_hashes
from tracemill.session import written

#: Weight of the pooled covariance in each class, and of its diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
#: A document with at least this score is predicted to be of class 1.
CUT = 0.3

_COUNTED = (r"\p{Lu}", r"[0-9]", r"[#*$%&<>]", r"\|", r"[!?]", r"[.,;:]", r"\n")
SIZE = 6 + len(_COUNTED)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text; shares are log odds with half a count added, so empty texts have some too."""
    texts = pa.concat_arrays([texts])
    words, begins = word_hashes(texts, lower=True)
    n_words, again = _repeats(texts)
    kinds = np.diff(distinct(words, begins)[1])
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)

    def share(part, whole):
        return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))

    counted = [pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False).astype(float) for p in _COUNTED]
    return np.stack(
        [
            np.log1p(n_words), np.log1p(chars / np.maximum(n_words, 1)), share(kinds, n_words), share(again, n_words),
            np.log1p(n_words / (counted[-1] + 1)), share(np.maximum(chars - n_words, 0), chars), *[share(c, chars) for c in counted],
        ],
        1,
    )


@dataclass
class Model:
    """Per class: mean, inverse of the Cholesky factor of the covariance, and log prior minus half the log determinant."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, whiten, offset in zip(self.means, self.whiten, self.offsets):
            apart = (x - mean) @ whiten.T
            density.append(offset - 0.5 * (apart * apart).sum(1))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def model_of(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """The model of two classes from their numbers of rows, sums, and sums of products.

    A class without rows takes the mean of the other; with no rows at all every score is 0.5.
    """
    d = sums.shape[1]
    if not counts.sum():
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    n = np.maximum(counts, 1)[:, None]
    means = sums / n
    means = np.where(counts[:, None] > 0, means, means[::-1])
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / max(counts.sum() - 2, 1)
    diagonal = np.diag(np.diag(pooled) + 1e-6)
    pooled = (1 - to_diagonal) * pooled + to_diagonal * diagonal
    whiten, offsets = [], []
    for k in range(2):
        own = scatter[k] / max(counts[k] - 1, 1)
        weight = to_pooled if counts[k] > 1 else 1.0
        factor = np.linalg.cholesky((1 - weight) * own + weight * pooled + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log((counts[k] + 1) / (counts.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Model(means, np.stack(whiten), np.array(offsets))


def _vectors(batches):
    for got in batches:
        for first, stop in portions(got.column(1)):
            x = statistics(got.column(1).slice(first, stop - first))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SIZE).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([got.column(0).slice(first, stop - first), values], ["doc_id", "x"])


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_vectors, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _moments(batches):
    totals = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for got in batches:
        x, label = _matrix(got.column(0)), got.column(1).to_numpy(zero_copy_only=False)
        for k in range(2):
            own = x[label == k]
            totals[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    at = [(k, j, float(v)) for k in range(2) for j, v in enumerate(totals[k]) if v]
    columns = list(zip(*at)) or [[]] * 3
    kinds = [pa.int32(), pa.int32(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["label", "at", "v"])


def held_out(doc_id):
    """Whether an id is in the fifth of all rows from which nothing is learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _taught(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(doc_id, label): the labels outside the held-out fifth."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return known.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Learn from all labelled rows outside the held-out fifth; rows has (doc_id, x)."""
    taught = rows.join(_taught(labels, label_col, id_col), "doc_id").select("x", "label")
    sums = taught.mapInArrow(_moments, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    totals = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for label, at, v in sums.collect():
        totals[label, at] = v
    return model_of(totals[:, 0], totals[:, 1 : 1 + SIZE], totals[:, 1 + SIZE :].reshape(2, SIZE, SIZE))


def _scored(batches, model: Model):
    for got in batches:
        if got.num_rows:
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(model.score(_matrix(got.column(1))))], ["doc_id", "score"])


def scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Only ids outside the held-out fifth, crc32(id as text) mod 5 = 0, teach; scores read the text
    alone. Defined cases: null and empty texts are scored by their (zero) counts; a null id is not
    held out and teaches nothing; repeated rows are scored each, and teach as often as they occur;
    labels that are null or neither 0 nor 1 are left out; without any labels every score is 0.5; an
    empty table gives no rows. Other columns are not read.
    """
    rows = written(vectors(docs, id_col, text_col), "statistics")
    model = fit(rows, labels, label_col, id_col)
    out = rows.mapInArrow(partial(_scored, model=model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _accepted(batches, model: Model, at: int, cut: float):
    for got in batches:
        for first, stop in portions(got.column(at)):
            part = got.slice(first, stop - first)
            yield part.filter(pa.array(model.score(statistics(part.column(at).fill_null(""))) >= cut))


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The documents that are predicted to be of class 1, with all their columns; texts are read once to learn and once to judge."""
    model = fit(vectors(docs, id_col, text_col), labels, label_col, id_col)
    return docs.mapInArrow(partial(_accepted, model=model, at=docs.columns.index(text_col), cut=cut), docs.schema)
