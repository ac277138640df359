"""A grammar of repeated pairs (Re-Pair) over many short sequences of symbols, built by rounds of counting and replacing.

Every round counts the adjacent pairs of all sequences, takes the most frequent ones of which none can overlap another, gives each a new
symbol and replaces them everywhere. A rule names two earlier symbols, so whatever composes can be evaluated once per rule, bottom-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import map_arrow, written

#: Rules at most, and rules of one round at most. Symbols that are over stay as they are in the sequences.
RULES, AT_ONCE = 1024, 128


def pair_counts(sequences: DataFrame) -> DataFrame:
    """(x, y, n): how often y follows x in ``sequences`` (one column, array<int>)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            lists = b.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            inside = np.ones(max(len(values) - 1, 0), bool)
            borders = np.cumsum(lengths)[:-1] - 1
            inside[borders[(borders >= 0) & (borders < len(inside))]] = False
            pairs = (values[:-1] << 32 | values[1:])[inside]
            keys, at = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(pairs), np.int64)]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], ["x", "y", "n"])

    return map_arrow(sequences, read, "x bigint, y bigint, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))


def without_overlap(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs, in order, less those that could share a symbol's place with one before: the replacements then need no order."""
    taken, firsts, seconds = [], set(), set()
    for x, y in pairs:
        if x not in seconds and y not in firsts and x != y:
            taken.append((x, y))
            firsts.add(x)
            seconds.add(y)
    return taken or pairs[:1]


def replace(symbols: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    out, i, n = [], 0, len(symbols)
    while i < n:
        made = rules.get((symbols[i], symbols[i + 1])) if i + 1 < n else None
        out.append(symbols[i] if made is None else made)
        i += 1 if made is None else 2
    return out


def pair_grammar(sequences: DataFrame, column: str, terminals: int, most: int = RULES, at_once: int = AT_ONCE) -> tuple[list[tuple[int, int]], DataFrame]:
    """Rules, the k-th of which stands for symbol ``terminals`` + k, and ``sequences`` (written) with ``column`` (array<int>) rewritten by them.

    Ends when no pair occurs twice or ``most`` rules are made; the driver holds the rules and one round's counts of ``at_once`` times four pairs.
    """
    rules: list[tuple[int, int]] = []
    at = sequences.columns.index(column)
    while len(rules) < most:
        often = pair_counts(sequences.select(column)).filter("n > 1").orderBy(F.desc("n"), "x", "y").limit(4 * at_once).collect()
        found = without_overlap([(r.x, r.y) for r in often])[: min(at_once, most - len(rules))]
        if not found:
            break
        made = {pair: terminals + len(rules) + k for k, pair in enumerate(found)}
        rules += found

        def read(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = pa.array([replace(s, made) for s in b.column(at).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

        sequences = written(map_arrow(sequences, read, sequences.schema), "grammar")
    return rules, sequences
