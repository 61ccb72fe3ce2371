"""Quality classifier: regularised quadratic discriminant on document statistics.

Each class is a Gaussian over transformed statistics of the text. Its covariance is shrunk
towards the diagonal of the pooled one, its Cholesky factor is inverted once and cached, and a
score is the logistic of the difference of Mahalanobis log-densities.

The statistics are made in one pass over the whole texts and kept as a table; the model is
fitted from sums (counts, means, cross-products) over all labelled training rows, which
partial aggregation reduces to a few hundred numbers however many rows there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import library_on_path, per_text, settle, text_hash

FEATURES = ("words", "word_len", "symbols", "upper", "digits", "ends", "caps", "variety", "top_word", "line_repeats", "gram_repeats", "packed", "odd_words", "marks")
#: Share of the pooled diagonal in each class covariance.
SHRINKAGE = 0.1
#: Log-density differences are divided by this before the logistic, as the statistics depend on each other.
TEMPERATURE = 4.0
THRESHOLD = 0.3
HOLD_OUT = 5

_UPPER, _DIGIT, _END, _MARK, _SYMBOL = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".!?",
    b",.;:!?'\"-",
    bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.;:!?'\"-"),
)


def _share(part: float, whole: float) -> float:
    """Variance-stabilised share of ``part`` in ``whole``."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    solid = sum(map(len, words))

    def count(chars: bytes) -> int:
        return size - len(raw.translate(None, chars))

    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = Counter(zip(words, words[1:], words[2:]))
    n_grams = max(1, n - 2)
    caps = sum(1 for w in counts if 65 <= w[0] <= 90)
    odd = sum(c for w, c in counts.items() if not (w[-1] >= 97 and w[-1] <= 122 or w[-1] > 127 or w[-1] in b".,"))
    return [
        float(np.log1p(n)),
        float(np.log(solid / n)),
        _share(count(_SYMBOL), size),
        _share(count(_UPPER), size),
        _share(count(_DIGIT), size),
        _share(count(_END), n),
        _share(caps, len(counts)),
        float(np.log(len(counts)) / np.log(n)) if n > 1 else 1.0,
        _share(max(counts.values()) - 1, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(n_grams - len(grams), n_grams),
        float(np.log((len(zlib.compress(raw, 1)) + 8) / (size + 8))),
        _share(odd, n),
        _share(count(_MARK), size),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and the statistics ``x`` of each row."""

    def of(ids: list, texts: list) -> Iterator[tuple]:
        return zip(ids, map(text_hash, texts), map(statistics, texts))

    return per_text(docs, id_col, text_col, lambda: of, "doc_id bigint, text_hash bigint, x array<double>")


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log weights of the classes 0 and 1."""

    means: np.ndarray
    inverse: np.ndarray
    offset: np.ndarray
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.einsum("cij,cnj->cni", self.inverse, x[None] - self.means[:, None])
        log_density = self.offset[:, None] - 0.5 * (z**2).sum(axis=2)
        gap = np.clip((log_density[1] - log_density[0]) / self.temperature, -50, 50)
        return 1 / (1 + np.exp(-gap))


def from_sums(n: np.ndarray, total: np.ndarray, cross: np.ndarray, shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE) -> Discriminant:
    """Fit from class counts, sums and cross-products; a class without rows takes the pooled shape."""
    d = total.shape[1]
    means = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], total.sum(0) / max(1, n.sum()))
    scatter = cross - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / max(1, n.sum())
    target = np.diag(np.maximum(np.diag(pooled), 1e-4))
    cov = np.where(n[:, None, None] > 1, scatter / np.maximum(n, 1)[:, None, None], pooled)
    lower = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * target)
    prior = (n + 1) / (n.sum() + 2)
    offset = np.log(prior) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, np.linalg.solve(lower, np.broadcast_to(np.eye(d), lower.shape)), offset, temperature)


def fit(features: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE) -> Discriminant:
    """Fit on ``features(doc_id, x)`` joined with ``labels(doc_id, quality)``.

    Labels that are null or not 0 or 1, and rows without a label, are not used. Only class
    sums reach the driver.
    """
    d = len(FEATURES)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = settle(known, "known-labels")  # as a table, so that AQE can split a hot id's join
    rows = features.join(known, "doc_id").select("quality", "x")
    parts = [F.col("x")[i] for i in range(d)]
    sums = [F.count("*").alias("n"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts))]
    sums += [F.sum(parts[i] * parts[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    n, total, cross = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows.groupBy("quality").agg(*sums).collect():  # two rows
        k = r["quality"]
        n[k], total[k] = r["n"], [r[f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                cross[k, i, j] = cross[k, j, i] = r[f"c{i}_{j}"]
    return from_sums(n, total, cross, shrinkage, temperature)


def held_out_column(id_col: str = "doc_id", folds: int = HOLD_OUT):
    """Whether crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash for every row of ``docs``.

    Null and empty texts have all statistics zero and get the score that the model gives
    those. Held-out rows are never learned from; a null id counts as not held out and has
    no label. Repeated rows are scored alike. Without any label both classes have one shape
    and every score is 0.5. Columns besides the id and the text are never read.
    """
    rows = settle(measured(docs, id_col, text_col), "statistics").withColumn("held_out", held_out_column())
    model = fit(rows.where("NOT held_out"), labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            s = model.score(x)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "text_hash"])

    with library_on_path(docs.sparkSession):
        return rows.select("doc_id", "held_out", "x", "text_hash").mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int, text_hash bigint")
