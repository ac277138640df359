"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A text is compressed window by window with either dictionary; where the toxic one gives the shorter result, the window
reads like toxic text. Both dictionaries share a base of ordinary text, so a window's difference comes only from what
each adds: segments trained on words of toxic texts, or of ordinary texts, that the base half of the ordinary sample
does not have. In later rounds both are trained again on the windows that the toxic dictionary shortened: rightly, in
toxic texts, and wrongly, in ordinary ones. The histogram of a text's differences is calibrated by logistic regression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import configure, kept, map_arrow, quoted, whole_text, written
from taxatrend.llm.labelled import held_out, sample
from taxatrend.llm.logistic import Logistic, area_under_curve, fit

#: Words of a window.
WINDOW = 10
LEVEL = 12
BASE_BYTES, OWN_BYTES = 65_536, 8_192
#: Labelled rows learnt from, per class; for the dictionaries, words taken from one of them (whole windows, drawn over the whole text) and windows in
#: all (drawn likewise). The calibration reads the whole texts of these rows.
PER_CLASS, WORDS_OF_ONE, WINDOWS = 3_000, 4_000, 400_000
ROUNDS = 3
EDGES = np.array([-1000, -3, -1, 0, 1, 2, 3, 4, 6, 8, 11, 1000])
BREAKS = re.compile(rb"[^a-z0-9'\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return [w for w in BREAKS.split(text.encode("utf-8", "surrogatepass").lower()) if w]


def windows(ws: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(ws[i : i + WINDOW]) + b" " for i in range(0, len(ws), WINDOW)]


def dictionary(size: int, samples: list[bytes]) -> bytes:
    """Segments that recur in the samples; where they are too few to train on, the samples themselves."""
    if len(samples) > WINDOWS:
        samples = [samples[i] for i in np.sort(np.random.default_rng(len(samples)).permutation(len(samples))[:WINDOWS])]
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


class Distance:
    """How many bytes shorter the toxic dictionary makes each window."""

    def __init__(self, base: bytes, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic + base), compressor(ordinary + base)

    def differences(self, ws: list[bytes]) -> np.ndarray:
        lengths = lambda c: np.fromiter((len(x) for at in range(0, len(ws), 4096) for x in c.multi_compress_to_buffer(ws[at : at + 4096])), np.int64, len(ws))
        return lengths(self.ordinary) - lengths(self.toxic)

    def features(self, ws: list[bytes]) -> np.ndarray:
        g = self.differences(ws)
        if not len(g):
            return np.zeros(len(EDGES) + 5)
        top = np.sort(g)[::-1]
        shares = np.histogram(g, EDGES)[0] / len(g)
        return np.array([*shares, top[0], top[:3].mean(), g.mean(), (g >= 3).mean(), np.log1p(len(g)), np.log1p((g >= 4).sum())])


@dataclass(frozen=True)
class Model:
    base: bytes
    toxic: bytes
    ordinary: bytes
    calibration: Logistic | None
    prior: float

    def scores(self, texts: list[str], distance: Distance) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.prior)
        return self.calibration.probability(np.array([distance.features(windows(words(t))) for t in texts]))


def learn(texts: list[list[bytes]], y: np.ndarray, measured: Callable[[bytes, bytes, bytes], np.ndarray]) -> Model:
    """The model from words of each sampled text and its label. ``measured(base, toxic, ordinary)`` gives the features of the whole texts, in the same order.

    Without examples of both kinds every text scores the share of toxic ones.
    """
    toxic, plain = np.flatnonzero(y), np.flatnonzero(1 - y)
    if len(toxic) < 4 or len(plain) < 4:
        return Model(b"", b"", b"", None, float(np.mean(y)) if len(y) else 0.0)
    half = len(plain) // 2
    known = {w for i in plain[:half] for w in texts[i]}
    new = lambda ws: [w for w in dict.fromkeys(ws) if w not in known]
    grouped = lambda ts: [w for t in ts for w in windows(t)]
    base = dictionary(BASE_BYTES, grouped(list(dict.fromkeys(texts[i])) for i in plain[:half]))
    train, tune = toxic[: (len(toxic) + 1) // 2], toxic[(len(toxic) + 1) // 2 :]
    from_toxic, from_plain = grouped(new(texts[i]) for i in train), grouped(new(texts[i]) for i in plain[half:])
    best, reached = None, -1.0
    # Distances are learnt from the first half of the toxic texts and judged on all of the second, never on held-out rows.
    judged = np.r_[tune, plain]
    for _ in range(ROUNDS):
        own = dictionary(OWN_BYTES, from_toxic), dictionary(OWN_BYTES, from_plain)
        x = measured(base, *own)[judged]
        calibration = fit(x, y[judged])
        area = area_under_curve(calibration.probability(x), y[judged])
        if area > reached:
            best, reached = Model(base, *own, calibration, 0.5), area
        d = Distance(base, *own)
        won = lambda rows, least: grouped(new([w for x, g in zip(ws, d.differences(ws)) if g >= least for w in x.split()]) for ws in (windows(texts[i]) for i in rows))
        from_toxic, from_plain = won(train, 3) or from_toxic, won(plain, 2) or from_plain
    return best


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled documents of each kind, none of the held-out fold; one that repeats is learnt from as often.

    The driver holds words of these rows and, in each round, the few features of their whole texts, which tasks compute.
    """
    configure(docs.sparkSession)
    drawn = sample(docs.select("doc_id", "text"), labels, label, per_class, held_out).select("text", F.col("sampled_label").alias("y"))
    rows = written(drawn.withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                ws = words(t)
                if len(ws) > WORDS_OF_ONE:
                    w = windows(ws)
                    ws = b"".join(w[i] for i in np.sort(np.random.default_rng(len(ws)).permutation(len(w))[: WORDS_OF_ONE // WINDOW])).split()
                out.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1), b.column(2)], ["words", "y", "row"])

    found = sorted((bytes(r.words), r.y, r.row) for r in map_arrow(rows, shorten, "words binary, y int, row bigint").collect())  # 2 * per_class rows at most
    order = np.random.default_rng(0).permutation(len(found))

    def measured(base: bytes, toxic: bytes, ordinary: bytes) -> np.ndarray:
        key = ("toxicity", hash((toxic, ordinary, base)))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = kept(key, lambda: Distance(base, toxic, ordinary))
            for b in batches:
                x = [d.features(windows(words(t))).tolist() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["row", "x"])

        by = {r.row: r.x for r in map_arrow(rows.select("row", "text"), read, "row bigint, x array<double>").collect()}
        return np.array([by[found[i][2]] for i in order])

    return learn([found[i][0].split() for i in order], np.array([found[i][1] for i in order], float), measured)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Whole texts are read; null counts as empty, an empty text has no window and scores what the calibration gives for
    none. Rows that repeat are scored alike, each by itself. Extra columns are ignored; an empty table gives none.
    """
    configure(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("doc_id"), whole_text(quoted(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    key = ("toxicity", hash((model.toxic, model.ordinary, model.base)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = kept(key, lambda: Distance(model.base, model.toxic, model.ordinary))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist(), d), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(rows, read, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
