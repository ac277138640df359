"""SentencePiece encoding and decoding over a table of distinct marked words.

The model marks every space with U+2581 and puts one mark before the text. No piece of it has a mark after another
character, so no piece reaches over the start of a run of marks: the text falls apart into chunks (a run of marks and the
characters up to the next mark) that are segmented independently. Each distinct chunk of a worker is segmented once, and
a text's ids are joined from the table by position; the same table holds what each chunk's ids decode to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from taxatrend.llm.chunk_table import ChunkTable
from taxatrend.llm.common import configure, fresh, kept, map_arrow, quoted, whole_text

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def splits_at_marks(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece has a mark behind another character, and text is taken as it is."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    probe = "AÄ  \tﬁ́ x "
    return not any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())) and model.normalize(probe) == MARK + probe.replace(" ", MARK)


class Codec:
    """The model and the table of one worker."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if not splits_at_marks(self.model):
            raise ValueError("pieces of this model cross whitespace markers: its texts can't be split into chunks")
        self.eos, self.lone = self.model.eos_id(), self.model.piece_to_id(MARK)
        self.surfaces: list[str] = []  # of the table's rows
        self.table = ChunkTable(self._encode)

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        # The model itself adds the first mark; alone it would be an empty text.
        ids = [x or [self.lone] for x in self.model.encode(chunks, num_threads=1)]
        self.surfaces += [" " + s for s in self.model.decode(ids, num_threads=1)]
        return ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """A text's chunks, each without its first mark; joined by marks they are the marked text."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str], add_eos: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids one after the other, where each text's end, and what they decode to."""
        rows = self.table.lookup(self.chunks(t) for t in texts)
        self.surfaces = self.surfaces[-len(self.table.rows) :]  # of a table that started anew, its own rows only
        flat, counts = self.table.gather(np.concatenate(rows) if rows else np.empty(0, np.int64))
        words = np.array([len(r) for r in rows], np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(words)] if len(rows) else np.empty(0, np.int64)
        surface = self.surfaces
        decoded = ["".join([surface[r] for r in rs.tolist()])[1:] for rs in rows]
        if add_eos:
            flat, ends = np.insert(flat, ends, self.eos), ends + np.arange(1, len(ends) + 1)
        return flat.astype(np.int32, copy=False), ends, decoded


def encode(docs: DataFrame, model: str, text_col: str = "text", add_eos: bool = True) -> DataFrame:
    """``docs`` with two more columns, ``ids`` (array<int>) and ``decoded`` (what decode(ids) gives), in their place.

    Exactly what the library gives for the whole text, with an end id if asked for. A null text is an empty one: no id
    but the end id, and "" decoded. Columns of ``docs`` named ids or decoded are replaced; all others pass through,
    whatever their type. ``model`` is the model's path on the executors. No shuffle; an empty table stays empty.
    """
    configure(docs.sparkSession)
    (text,) = fresh(docs, "text_to_encode")
    rest = [quoted(c) for c in docs.columns if c not in ("ids", "decoded")]
    rows = docs.select(*rest, whole_text(quoted(text_col)).alias(text))
    schema = StructType([*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    width = len(rest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("sentencepiece", model), lambda: Codec(model))
        for b in batches:
            flat, ends, decoded = codec.encode(b.column(width).to_pylist(), add_eos)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], ids, pa.array(decoded, pa.string())], [*b.schema.names[:width], "ids", "decoded"])

    return map_arrow(rows, read, schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` (replaced if there): the library's decode of each id list; null ids count as none."""
    configure(rows.sparkSession)
    (ids,) = fresh(rows, "ids_to_decode")
    rest = [quoted(c) for c in rows.columns if c != "decoded"]
    given = rows.select(*rest, F.coalesce(quoted(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias(ids))
    width = len(rest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept(("sentencepiece", model), lambda: Codec(model)).model
        for b in batches:
            texts = [m.decode(x) if x else "" for x in b.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(texts, pa.string())], [*b.schema.names[:width], "decoded"])

    return map_arrow(given, read, StructType([*given.schema.fields[:-1], StructField("decoded", StringType())]))
