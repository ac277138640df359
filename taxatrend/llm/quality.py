"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

Both start from the same labelled rows. In every round each view labels the unlabelled rows it is sure of for the other
view, both are fitted again, and at the end the log-odds of the two, calibrated together on labelled rows that neither
was fitted on, score every document. A view that knows nothing of quality is never sure, so it teaches nothing and gets
no weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from taxatrend.llm.common import configure, fresh, map_arrow, quoted, whole_text
from taxatrend.llm.labelled import held_out
from taxatrend.llm.logistic import Logistic, fit

#: Labelled rows of each class, and unlabelled rows, that the views learn from: those with the smallest hashes of their ids.
PER_CLASS, POOL = 3_000, 10_000
ROUNDS = 4
#: A view labels rows for the other one from this calibrated probability on, and at most so many of a class in a round.
SURE, TAUGHT = 0.97, 1_000
META = ("lang", "source", "n_chars")
BUCKETS = 24
RUNS = re.compile(r"([^\w\s.])\1")


def content_features(text: str) -> list[float]:
    """Shares and means over the whole text; all zero for an empty one."""
    w = text.split()
    if not w:
        return [0.0] * CONTENT
    n, chars = len(w), len(text)
    lower = [x.lower() for x in w]
    counts = Counter(lower)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(lower, lower[1:]))
    symbols = sum(map(text.count, "|!%$&*#{}<>=~^_"))
    upper = sum(map(str.isupper, w))
    ends = sum(x[-1] in ".!?" for x in w)
    digits = sum(map(text.count, "0123456789"))
    top = counts.most_common(1)[0][1] / n
    return [
        np.log1p(n), chars / n / 10, upper / n, symbols / n, len(RUNS.findall(text)) / n, repeats / n, 1 - len(counts) / n, (1 - len(counts) / n) / np.log(n + 2),
        top, 1 - len(set(lines)) / max(len(lines), 1), ends / n, digits / chars, text.count("|") / n, text.count("!") / n, float(n < 8), len(lines) / n,
    ]


CONTENT = 16


def metadata_features(values: tuple) -> list[float]:
    """Hashed one-hot of text columns, log of numeric ones; null is a value of its own."""
    out: list[float] = []
    for k, v in enumerate(values):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out += [float(np.log1p(max(v, 0))), 0.0]
        elif v is None:
            out += [0.0, 1.0]
        else:
            out += [0.0, 0.0]
        hot = [0.0] * BUCKETS
        if isinstance(v, str):
            hot[zlib.crc32(f"{k}:{v}".encode("utf-8", "surrogatepass")) % BUCKETS] = 1.0
        out += hot
    return out


@dataclass(frozen=True)
class Model:
    content: Logistic | None
    metadata: Logistic | None
    combined: Logistic | None
    prior: float

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.combined is None:
            same = np.full(len(content), self.prior)
            return same, same, same
        a, b = self.content.log_odds(content), self.metadata.log_odds(metadata)
        return self.content.probability(content), self.metadata.probability(metadata), self.combined.probability(np.c_[a, b])


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray) -> Model:
    """``y``: 1 good, 0 bad, -1 unlabelled. Without five labelled rows of each class every document scores the share of good ones (1 without labels)."""
    given = np.flatnonzero(y >= 0)
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return Model(None, None, None, float(y[given].mean()) if len(given) else 1.0)
    views, pool = [content, metadata], np.flatnonzero(y < 0)
    tuning = given[id_hashes(given) % 3 == 0]  # a third of the labelled rows of each class, kept for calibration
    start = np.setdiff1d(given, tuning)
    if len(set(y[tuning])) < 2 or len(set(y[start])) < 2:
        tuning = start = given
    rows, labels, models = [start, start], [y[start].astype(float)] * 2, [None, None]
    for _ in range(ROUNDS):
        models = [fit(v[r], k) for v, r, k in zip(views, rows, labels)]
        for me, other in ((0, 1), (1, 0)):
            odds = fit(models[me].log_odds(views[me][tuning])[:, None], y[tuning].astype(float))  # what this view's certainty is worth
            p = odds.probability(models[me].log_odds(views[me][pool])[:, None])
            order = np.argsort(p, kind="stable")
            bad, good = [i for i in order[:TAUGHT] if p[i] <= 1 - SURE], [i for i in order[::-1][:TAUGHT] if p[i] >= SURE]
            taught = pool[np.array(bad + good, dtype=np.int64)]
            rows[other] = np.r_[start, taught]
            labels[other] = np.r_[y[start], np.zeros(len(bad)), np.ones(len(good))].astype(float)
    models = [fit(v[r], k) for v, r, k in zip(views, rows, labels)]
    both = np.c_[models[0].log_odds(content[tuning]), models[1].log_odds(metadata[tuning])]
    return Model(models[0], models[1], fit(both, y[tuning].astype(float)), float(y[given].mean()))


def id_hashes(rows: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(r).encode()) for r in rows.tolist()])


def featured(docs: DataFrame, text_col: str, meta: list[Column], keep: list[str], out: list[tuple[str, object]], make) -> DataFrame:
    """``docs[keep]`` with columns that ``make(content, metadata)`` gives for a batch's features."""
    configure(docs.sparkSession)
    rows = docs.select(*[quoted(c) for c in keep], whole_text(quoted(text_col)), *meta)
    width, n = len(keep), len(meta)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = np.array([content_features(t) for t in b.column(width).to_pylist()]).reshape(-1, CONTENT)
            values = [b.column(width + 1 + k).to_pylist() for k in range(n)]
            metadata = np.array([metadata_features(v) for v in zip(*values)] if n else [[0.0]] * b.num_rows).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *make(content, metadata)], [f"c{i}" for i in range(width + len(out))])

    return map_arrow(rows, read, StructType([*rows.schema.fields[:width], *[StructField(c, t) for c, t in out]]))


def metadata_columns(docs: DataFrame, meta: tuple[str, ...]) -> list[Column]:
    """The metadata columns; one that ``docs`` lacks is null throughout."""
    return [quoted(c) if c in docs.columns else F.lit(None).cast("string") for c in meta]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = META, per_class: int = PER_CLASS, pool: int = POOL) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class and ``pool`` others; labels of the held-out fold are not read.

    A document labelled twice counts as good only if all its labels say so; null labels and ids take no part.
    """
    one = F.col("doc_id")
    given = labels.filter(quoted(label).isNotNull() & one.isNotNull()).groupBy("doc_id").agg(F.min(quoted(label)).cast("int").alias("y")).filter(~held_out(one))
    order = F.xxhash64(one.cast("string"))
    pick = lambda k: given.filter(F.col("y") == k).orderBy(order, "doc_id").limit(per_class)
    ids = docs.select(quoted(id_col).alias("doc_id")).filter(one.isNotNull() & ~held_out(one))
    drawn = ids.orderBy(order, "doc_id").limit(pool).distinct().withColumn("y", F.lit(-1))
    # 2 * per_class + pool ids at most: small enough to send to every task.
    chosen = pick(0).unionByName(pick(1)).unionByName(drawn).groupBy("doc_id").agg(F.max("y").alias("y"))
    columns = metadata_columns(docs, meta)
    y_name, id_name = fresh(docs, "sampled_label", "sampled_id")
    met = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias(id_name), F.col("y").alias(y_name))), quoted(id_col) == F.col(id_name))
    as_lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    rows = featured(met, text_col, columns, [id_name, y_name], [("content", ArrayType(DoubleType())), ("metadata", ArrayType(DoubleType()))], lambda c, m: [as_lists(c), as_lists(m)])
    found = sorted((r[0], r[1], r[2], r[3]) for r in rows.collect())
    if not found:
        return Model(None, None, None, 1.0)
    return co_train(np.array([r[2] for r in found]), np.array([r[3] for r in found]), np.array([r[1] for r in found]))


def score(docs: DataFrame, model: Model, text_col: str = "text", meta: tuple[str, ...] = META, names: tuple[str, str, str] = ("content_score", "metadata_score", "score")) -> DataFrame:
    """``docs`` with content_score, metadata_score and score, each from 0 to 1, higher for better; columns of these ``names`` are replaced.

    Whole texts are read. Null text counts as empty and has zero features; null metadata is a value of its own, as are
    missing metadata columns. Rows that repeat are scored alike. An empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in names]
    out = [(c, DoubleType()) for c in names]
    return featured(docs, text_col, metadata_columns(docs, meta), keep, out, lambda c, m: [pa.array(x, pa.float64()) for x in model.scores(c, m)])


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", meta: tuple[str, ...] = META) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their own columns, whatever these are called."""
    names = fresh(docs, "content_score", "metadata_score", "score")
    return score(docs, model, text_col, meta, tuple(names)).filter(F.col(names[2]) >= least).select(*[quoted(c) for c in docs.columns])
