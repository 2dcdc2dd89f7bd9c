"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance; the covariance is shrunk towards the pooled one and that
towards a multiple of the identity. A document's score is the logistic of the difference of the
classes' log densities, each a Mahalanobis distance through a cached Cholesky factor, plus the
difference of log priors.

Fitting takes sums over all labelled training rows, made where the rows are and added up by Spark,
so nothing is sampled and only a fixed number of sums comes to the driver. Labels, language,
source and ids are never inputs of a score.

Defined cases: a null or empty text has the statistics of an empty one and gets a score like any
other; label rows that are null, or whose document is absent, are not used, and one document's
several labels count once, as the lowest; if a class has no training rows, every score is the
share of label 1 among those there are, or 0.5 with none; an empty table gives an empty result;
other columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import lean, mapped, only, small_batches, table, written

KEEP_FROM = 0.7
#: Share of the pooled covariance in each class's, and of the identity in the result.
TO_POOLED, TO_IDENTITY = 0.2, 0.02
#: Standardised statistics are held within this many deviations.
HELD = 6.0

STATISTICS = (
    "log_bytes", "upper", "high", "digits", "exclaim", "bars", "marks", "stops", "others", "white",
    "entropy", "word_length", "word_spread", "short_words", "distinct_words", "repeated_lines", "line_length",
)
N = len(STATISTICS)
_SUMS = N + N * N + 1


def statistics(text: str | None) -> list[float]:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    n = len(data)
    if not n:
        return [0.0] * N
    c = np.bincount(data, minlength=256) / n
    found = text.split()
    lengths = np.fromiter(map(len, found), "f8", len(found)) if found else np.zeros(1)
    lines = text.split("\n")
    some = c[c > 0]
    marks = c[[35, 36, 37, 38, 42]].sum()
    stops = c[[44, 46, 58, 59, 63]].sum()
    letters = c[65:91].sum() + c[97:123].sum() + c[128:].sum()
    white = c[[9, 10, 13, 32]].sum()
    rest = max(0.0, 1 - letters - white - marks - stops - c[48:58].sum() - c[33] - c[124])
    return [
        float(np.log1p(n)),
        *(float(np.sqrt(v)) for v in (c[65:91].sum(), c[128:].sum(), c[48:58].sum(), c[33], c[124], marks, stops, rest, white)),
        float(-(some * np.log(some)).sum()),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        float((lengths <= 3).mean()),
        len(set(found)) / len(found) if found else 0.0,
        (len(lines) - len(set(lines))) / (len(lines) + 6),
        float(np.log1p(n / len(lines))),
    ]


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    prior: float
    means: tuple[np.ndarray, ...] = ()
    #: Inverse Cholesky factors and log determinants, one for each class.
    factors: tuple[np.ndarray, ...] = ()
    logdets: tuple[float, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.centre) / self.scale, -HELD, HELD)
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        gap = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -40, 40)))


def solve(sums: dict[int, np.ndarray]) -> Model:
    """The model from each class's count, sums and sums of products."""
    count = {k: v[0] for k, v in sums.items()}
    total = sum(count.values())
    if min(count.get(0, 0), count.get(1, 0)) == 0:
        return Model(np.zeros(N), np.ones(N), float(count.get(1, 0) / total) if total else 0.5)
    mean = {k: v[1 : N + 1] / v[0] for k, v in sums.items()}
    product = {k: v[N + 1 :].reshape(N, N) / v[0] for k, v in sums.items()}
    centre = sum(v[1 : N + 1] for v in sums.values()) / total
    spread = np.diag(sum(v[N + 1 :].reshape(N, N) for v in sums.values()) / total) - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-8))
    own = {k: (product[k] - np.outer(mean[k], mean[k])) / np.outer(scale, scale) for k in (0, 1)}
    pooled = sum(own[k] * count[k] for k in (0, 1)) / total
    means, factors, logdets = [], [], []
    for k in (0, 1):
        shrunk = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
        shrunk = (1 - TO_IDENTITY) * shrunk + TO_IDENTITY * max(np.trace(shrunk) / N, 1e-3) * np.eye(N)
        lower = np.linalg.cholesky(shrunk)
        means.append((mean[k] - centre) / scale)
        factors.append(np.linalg.inv(lower))
        logdets.append(float(2 * np.log(np.diag(lower)).sum()))
    return Model(centre, scale, float(count[1] / total), tuple(means), tuple(factors), tuple(logdets))


def _measure(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            got = [statistics(t.as_py()) for t in batch.column(text_at)]
            kept = [c for k, c in enumerate(batch.columns) if k != text_at]
            names = [c for k, c in enumerate(batch.schema.names) if k != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got, pa.list_(pa.float64()))], [*names, "x"])

    return run


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each document."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_measure(1)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        quality = batch.column(0).to_numpy()
        x = np.array(batch.column(1).to_pylist(), "f8").reshape(-1, N)
        for k in (0, 1):
            own = x[quality == k]
            sums[k] = sums.get(k, np.zeros(_SUMS)) + np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(_SUMS, k)), pa.array(np.arange(_SUMS)), pa.array(v)], ["quality", "at", "v"])


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the label rows that may be learned from."""
    rows = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def fit(x: DataFrame, labels: DataFrame) -> Model:
    """``x``: measured documents. Two times 307 sums come to the driver."""
    rows = x.join(training(labels), "doc_id").select("quality", "x")
    added = rows.mapInArrow(lean(_add_up), "quality long, at long, v double").groupBy("quality", "at").agg(F.sum("v").alias("v"))
    sums = {0: np.zeros(_SUMS), 1: np.zeros(_SUMS)}
    for r in added.collect():
        sums[r["quality"]][r["at"]] = r["v"]
    return solve(sums)


def _score(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), "f8").reshape(-1, N)
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            names = [c for k, c in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.scores(x), pa.float64())], [*names, "score"])

    return run


def scored(x: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    return x.mapInArrow(lean(_score(model, 1)), f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def _keep(model: Model, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(text_at)], "f8").reshape(-1, N)
            yield batch.filter(pa.array(model.scores(x) >= least))

    return run


def good_documents(docs: DataFrame, labels: DataFrame, least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns as they were."""
    small_batches(docs.sparkSession)
    # Measuring every document twice costs less than sending the labelled texts through a shuffle.
    model = fit(measured(docs), labels)
    return mapped(docs, _keep(model, docs.columns.index("text"), least)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = written(measured(table(spark, sf_dir, "documents")), "statistics")
    model = fit(x, table(spark, sf_dir, "labels"))
    return scored(x, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted")
    )
