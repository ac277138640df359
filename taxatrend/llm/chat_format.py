"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant in turn, ending with the assistant. Each given
turn may be kept, relabelled, merged into the turn before it, or preceded by an empty inserted turn, each at a cost. With
the last rendered role as state, a turn is a small matrix of costs, and a stretch of turns is their (min, +) product: so
a conversation of any length is cut into chunks of so many rows, chunks are multiplied in groups, level by level, and the
cheapest path is handed down again from the whole to the chunks and from chunks to turns. No task holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxatrend.llm.common import configure, map_arrow, quoted, whole_text, written
from taxatrend.llm.numbering import numbered

ROLES = ["system", "user", "assistant"]
#: States: nothing rendered yet, or the role rendered last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: [SYSTEM, USER], SYSTEM: [USER], USER: [ASSISTANT], ASSISTANT: [USER]}
NEVER = 1 << 40
#: Rows of a chunk, and chunks of a group one level up.
SPAN = 256


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 3
    #: Relabelling by (given role, rendered role); a role that is none of the three is given as "other".
    relabel: dict[tuple[str, str], int] = field(default_factory=lambda: {
        ("system", "user"): 2, ("system", "assistant"): 6, ("user", "assistant"): 5, ("assistant", "user"): 5,
        ("user", "system"): 8, ("assistant", "system"): 8, ("other", "system"): 8, ("other", "user"): 2, ("other", "assistant"): 2,
    })


class Automaton:
    """Cost matrices and the cheapest move for every given role."""

    def __init__(self, costs: Costs):
        self.cost, self.move = {}, {}
        for role in [*ROLES, "other"]:
            c, m = np.full((4, 4), NEVER, np.int64), {}
            for s in range(4):
                for x in (SYSTEM, USER, ASSISTANT):
                    name = ROLES[x - 1]
                    base = 0 if role == name else costs.relabel[role, name]
                    ways = [(base, 0, None)] if x in NEXT[s] else []
                    ways += [(base + costs.merge, 1, None)] if s == x else []
                    ways += [(base + costs.insert, 2, y) for y in NEXT[s] if x in NEXT[y]]
                    if ways:
                        least = min(ways, key=lambda w: w[:2])
                        c[s, x], m[s, x] = least[0], least
            self.cost[role], self.move[role] = c, m
        self.end = np.array([0, 2 * costs.insert, costs.insert, 0], np.int64)

    def product(self, matrices: list[np.ndarray]) -> np.ndarray:
        out = matrices[0]
        for m in matrices[1:]:
            out = np.minimum((out[:, :, None] + m[None, :, :]).min(axis=1), NEVER)
        return out

    def walk(self, matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
        """States after each matrix on a cheapest path from entry to exit; of equal ones that with the smaller states last."""
        best = [np.where(np.arange(4) == entry, 0, NEVER)]
        for m in matrices:
            best.append(np.minimum((best[-1][:, None] + m).min(axis=0), NEVER))
        path = [exit_]
        for k in range(len(matrices) - 1, 0, -1):
            path.append(int((best[k] + matrices[k][:, path[-1]]).argmin()))
        return path[::-1]


def by_group(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``make(key, rows)`` for every group of bounded size; rows are tuples in ``order``. Groups stream past, sorted."""
    out = StructType.fromDDL(schema)
    width = len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made)) if made else [[] for _ in out.fields]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), kind.type) for c, kind in zip(columns, arrow)], [k.name for k in arrow])
            made.clear()
            return batch

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = list(to_arrow_schema(out))
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:width] != key:
                    if rows:
                        made += make(key, rows)
                    key, rows = row[:width], []
                    if len(made) >= 4096:
                        yield flush()
                rows.append(row)
        if rows:
            made += make(key, rows)
        yield flush()

    return map_arrow(df.repartition(*[quoted(k) for k in keys]).sortWithinPartitions(*keys, *order), read, out)


def flat(m: np.ndarray) -> list[int]:
    return m.ravel().tolist()


def square(cells: list[int]) -> np.ndarray:
    return np.array(cells, np.int64).reshape(4, 4)


def known_role(role: Column) -> Column:
    name = F.lower(F.trim(role.cast("string")))
    return F.when(name.isin(ROLES), name).otherwise("other")


def turn_key() -> Column:
    """A digest that two turns share if they are the same in conversation, number, role and text, as given."""
    return F.unhex(F.sha2(F.concat(F.to_json(F.struct("conv_id", "given_turn", "given_as")), F.lit("\n"), F.col("text")), 256))


def format_chats(turns: DataFrame, costs: Costs | None = None, header: str = "<|{role}|>\n", end: str = "<|end|>\n", joint: str = "\n\n") -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> one row per turn, in order of position within its conversation.

    conv_id, turn, given_role, role (rendered), merged, inserted (the empty turn before it, or null), cost, rendered,
    position (its number in the conversation, from 0). The ``rendered`` of a conversation's rows, one after the other, are its formatted
    text. Roles are read without case and outer blanks; null or unknown ones are "other", null texts are empty. Turns are
    ordered by number (null counts as -1), role and a hash of the text; only a row repeated whole, its number and role as given, is one turn.
    Turns without conv_id make up one conversation. At most SPAN rows of a conversation are held at once, without their texts, which move
    once, to meet what is put before and after them. Extra columns are ignored.
    """
    configure(turns.sparkSession)
    rules = Automaton(costs or Costs())
    over = lambda c: F.expr(f"{c} div {SPAN}").cast("long")
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("given_turn"), F.col("role").cast("string").alias("given_as"), whole_text(F.col("text")).alias("text")).withColumn("key", turn_key())
    narrow = plain.select("conv_id", F.coalesce("given_turn", F.lit(-1)).alias("turn"), known_role(F.col("given_as")).alias("given"), F.xxhash64("text").alias("h"), "key")
    different = written(narrow.dropDuplicates(["key"]), "chat-different")
    inorder = numbered(different, ["conv_id"], ["turn", "given", "h", "key"], name="chat-runs")
    rows = written(inorder.withColumn("chunk", over("number")).select("conv_id", "turn", "given", "key", "number", "chunk"), "chat-turns")
    kind = rows.schema["conv_id"].dataType.simpleString()
    cells = f"conv_id {kind}, chunk bigint, cells array<bigint>"

    def turn_product(key: tuple, found: list[tuple]) -> list[tuple]:
        return [(*key, flat(rules.product([rules.cost[r[3]] for r in found])))]

    def chunk_product(key: tuple, found: list[tuple]) -> list[tuple]:
        return [(*key, flat(rules.product([square(r[3]) for r in found])))]

    levels = [written(by_group(rows.select("conv_id", "chunk", "number", "given"), ["conv_id", "chunk"], ["number"], turn_product, cells), "chat-chunks")]
    while levels[-1].groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        up = levels[-1].select("conv_id", over("chunk").alias("up"), "chunk", "cells")
        levels.append(written(by_group(up, ["conv_id", "up"], ["chunk"], chunk_product, cells), "chat-chunks"))

    path = f"conv_id {kind}, chunk bigint, entry int, exit int, is_last boolean"

    def whole(key: tuple, found: list[tuple]) -> list[tuple]:
        return [(*key, START, int((square(found[0][2])[START] + rules.end).argmin()), True)]

    def hand_down(key: tuple, found: list[tuple]) -> list[tuple]:
        states = rules.walk([square(r[3]) for r in found], found[0][4], found[0][5])
        return [(key[0], r[2], a, b, r[6] and k == len(found) - 1) for k, (r, a, b) in enumerate(zip(found, [found[0][4], *states[:-1]], states))]

    paths = by_group(levels[-1], ["conv_id", "chunk"], [], whole, path)
    for level in levels[-2::-1]:
        above = written(paths, "chat-paths").toDF("c", "up", "entry", "exit", "is_last")
        below = level.withColumn("up", over("chunk"))
        met = below.join(above.withColumnRenamed("up", "u"), below.conv_id.eqNullSafe(F.col("c")) & (below.up == F.col("u")))
        paths = by_group(met.select("conv_id", "up", "chunk", "cells", "entry", "exit", "is_last"), ["conv_id", "up"], ["chunk"], hand_down, path)

    def render(key: tuple, found: list[tuple]) -> list[tuple]:
        states = rules.walk([rules.cost[r[3]] for r in found], found[0][6], found[0][7])
        out, before = [], found[0][6]
        for place, (r, state) in enumerate(zip(found, states)):
            cost, way, between = rules.move[r[3]][before, state]
            role = ROLES[state - 1]
            ahead, after = joint if way == 1 else end if before != START else "", ""
            if way == 2:
                ahead += header.format(role=ROLES[between - 1]) + end
            if way != 1:
                ahead += header.format(role=role)
            if found[0][8] and place == len(found) - 1:
                cost += int(rules.end[state])
                after = end
                while state != ASSISTANT:
                    state = NEXT[state][0]
                    after += header.format(role=ROLES[state - 1]) + end
            out.append((key[0], r[2], r[3], role, way == 1, ROLES[between - 1] if way == 2 else None, int(cost), ahead, after, r[4], r[5]))
            before = states[place]
        return out

    done = written(paths, "chat-paths").toDF("c", "k", "entry", "exit", "is_last")
    met = rows.join(done, rows.conv_id.eqNullSafe(F.col("c")) & (rows.chunk == F.col("k")))
    put = by_group(
        met.select("conv_id", "chunk", "turn", "given", "number", "key", "entry", "exit", "is_last"), ["conv_id", "chunk"], ["number"], render,
        f"conv_id {kind}, turn bigint, given_role string, role string, merged boolean, inserted string, cost bigint, ahead string, after string, position bigint, key binary",
    )
    texts = plain.select("key", "text").dropDuplicates(["key"])
    return put.join(texts, "key").select(
        "conv_id", "turn", "given_role", "role", "merged", "inserted", "cost", F.concat("ahead", "text", "after").alias("rendered"), "position",
    )
