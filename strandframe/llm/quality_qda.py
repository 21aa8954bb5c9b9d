"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes twelve transformed statistics (shares under a square root, counts under a logarithm). For each class
the mean and covariance come from sums over all learning rows; the covariance is shrunk towards the pooled one and the
pooled one towards its diagonal. A score is the logistic of the difference of the Mahalanobis log densities, computed
from cached inverse Cholesky factors.

Defined results: a null or empty text has the statistics 0 and is scored from them; labels with a null id or quality
teach nothing; with a missing class every score is the share of good rows among the learning rows (0.5 without any);
repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_crc, small_batches

FEATURES = ["log_words", "word_len", "long_words", "distinct", "runs", "top_word", "upper", "symbols", "marks", "digits", "pipes", "dup_lines"]
SHRINK_CLASS, SHRINK_POOLED = 0.1, 0.05
THRESHOLD = 0.7
UPPER = bytes(range(65, 91))
#: As bytes: what counts as a symbol, an emphatic mark and a digit.
SYMBOLS, MARKS, DIGITS = b"#*$%&<>", b"!?", b"0123456789"


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    solid = sum(map(len, words))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    runs = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # twenty imagined plain words, so that a short text's chance shares count for little
    root = lambda part, whole, more=20: (part / (whole + more)) ** 0.5
    # the share of distinct words falls with length by nature, about as this power
    return [
        np.log1p(n), np.log1p(solid / n), root(sum(len(w) > 24 for w in words), n), min(1.0, (len(seen) + 20) / (n + 20) ** 0.85), root(runs, n), root(max(seen.values()) - 1, n),
        root(count(UPPER), solid, 100), root(count(SYMBOLS), solid, 100), root(count(MARKS), solid, 100), root(count(DIGITS), solid, 100), root(raw.count(b"|"), n), root(len(lines) - len(set(lines)), len(lines), 2),
    ]


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        got = np.array([statistics(t) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(b.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(got[:, i]) for i in range(len(FEATURES))]], ["doc_id", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def learns(doc_id: Column) -> Column:
    return id_crc(doc_id) % 4 != 2


def fit(found: DataFrame, labels: DataFrame) -> dict:
    """Class means and inverse Cholesky factors; one row of sums for each class reaches the driver."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learns(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropDuplicates(["doc_id"])
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = found.join(marked, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in FEATURES], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    rows = {r["quality"]: r for r in sums}
    n = {y: rows[y]["n"] if y in rows else 0 for y in (0, 1)}
    if min(n.values()) < 2:
        return {"share": n[1] / sum(n.values()) if sum(n.values()) else 0.5}
    mean, scatter = {}, {}
    for y in (0, 1):
        mean[y] = np.array([rows[y][f] for f in FEATURES]) / n[y]
        s = np.zeros((d, d))
        for i, j in pairs:
            s[i, j] = s[j, i] = rows[y][f"s{i}_{j}"] / n[y] - mean[y][i] * mean[y][j]
        scatter[y] = s
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / (n[0] + n[1])
    pooled = (1 - SHRINK_POOLED) * pooled + SHRINK_POOLED * np.diag(np.diag(pooled)) + 1e-5 * np.eye(d)
    model: dict = {"prior": float(np.log(n[1] / n[0]))}
    for y in (0, 1):
        chol = np.linalg.cholesky((1 - SHRINK_CLASS) * scatter[y] + SHRINK_CLASS * pooled)
        model[y] = {"mean": mean[y], "inverse": np.linalg.inv(chol), "log_det": float(2 * np.log(np.diag(chol)).sum())}
    return model


def score(model: dict) -> Column:
    """Probability of quality 1 from the statistics columns."""
    if "share" in model:
        return F.lit(float(model["share"]))
    density = {}
    for y in (0, 1):
        m, total = model[y], F.lit(0.0)
        centred = [F.col(f) - float(m["mean"][i]) for i, f in enumerate(FEATURES)]
        for i in range(len(FEATURES)):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + centred[j] * float(m["inverse"][i, j])
            total = total + z * z
        density[y] = -0.5 * (total + m["log_det"])
    return 1 / (1 + F.exp(-(density[1] - density[0] + model["prior"])))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics and score of every document; one pass over the text."""
    small_batches(docs.sparkSession)
    found = cut(features(docs))
    return found.withColumn("score", score(fit(found, labels)))
