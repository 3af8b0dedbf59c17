"""Quality scores by histogram gradient-boosted trees over document statistics.

Training needs labels and a bounded sample of feature rows, so it runs on the driver; statistics are computed once for all
documents on Spark, and scores by walking all trees at once over flat arrays in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_of_id, table, text_slices
from .docstats import FEATURES, features

#: At most about so many labelled rows train the trees (a hash of the id picks them when there are more).
MAX_TRAINING_ROWS = 40_000


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node i of a tree has the children 2i+1 and 2i+2; leaves follow the inner nodes."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0) -> Forest:
    """Newton boosting of the logistic loss on binned features; without rows, or with one class, a constant."""
    n, width = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, 1), dtype=np.int64), np.zeros((0, 1)), np.zeros((0, 2)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw, inner = np.full(n, base), 2**depth - 1
    out_f, out_t, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(n, dtype=np.int64), np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            sums = np.zeros((2, width, count, bins))
            for j in range(width):
                key = at * bins + binned[:, j]
                sums[0, j] = np.bincount(key, weights=g, minlength=count * bins).reshape(count, bins)
                sums[1, j] = np.bincount(key, weights=h, minlength=count * bins).reshape(count, bins)
            left = sums.cumsum(axis=3)
            whole = left[:, :, :, -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
            gain[(left[1] < 1) | (right[1] < 1)] = 0
            best = gain.transpose(1, 0, 2).reshape(count, -1)
            for k in range(count):
                choice = int(best[k].argmax())
                j, b = divmod(choice, bins)
                if best[k, choice] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + l2)
        raw += leaf[at]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(leaf)
    return Forest(np.stack(out_f), np.stack(out_t), np.stack(out_l), base)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = features(batch.column("text"))
        flat = pa.array(rows.ravel(), type=pa.float32())
        lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32), flat)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


def score(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS
) -> DataFrame:
    """Score docs (doc_id, text): columns doc_id, held_out, score in [0, 1].

    Rows for which `held_out` (a column over doc_id) is true never train. Null and empty texts have statistics of zero and a
    score like any other; an id with several labels counts with the largest; null labels and ids train nothing; without any
    label every score is the constant 0.5. A text of any length is counted whole by one task, repeated rows are scored one by
    one, and an empty table gives no rows. Other columns of docs are not looked at.
    """
    held = F.lit(False) if held_out is None else held_out
    stats = table(docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, x array<float>"), "statistics")
    known = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 30))
    # a repeated document trains once; of several texts the least statistics, whichever task comes first
    rows = stats.join(known.where(keep), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    sample = rows.orderBy("doc_id").toPandas()
    x = np.array(sample["x"].tolist(), dtype=np.float32).reshape(-1, len(FEATURES))
    forest = fit(x, sample["y"].to_numpy(dtype=np.float64))

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["x"].tolist(), dtype=np.float32).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": forest.predict(x)})

    scored = stats.mapInPandas(apply, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score")


def by_crc(modulus: int, remainder: int) -> Column:
    """The split by crc32 of the id as text."""
    return F.pmod(crc_of_id(), F.lit(modulus)) == remainder
