"""Conversation structure repair: the cheapest edits that make a legal sequence of turns, by grammar-compressed dynamic programming.

A turn is a symbol of its role and its fault. A symbol is a matrix: for every pair of states of the automaton
``(s?(ua)+)?`` the least cost of getting from one to the other over this turn, with the edits as an audit string, of
equals the least in ASCII. A stretch of turns is the (min, +) product of its symbols. The symbol sequences of all
conversations share one Re-Pair grammar, so a rule's matrix is computed once, bottom-up, its audits being ropes over those of its two halves, and
every different sequence is a short product, shared by all conversations that have it.

Insertions belong to the turn after them. The audits of one stretch between two states then end with a letter of its last turn, and none is a
proper beginning of another, so that the least of a concatenation is made of the least of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxatrend.llm.common import configure, kept, map_arrow, quoted, written
from taxatrend.llm.numbering import numbered
from taxatrend.llm.pair_grammar import pair_grammar

#: States: nothing put out yet, or the initial of the turn put out last. Classes of roles by their initial; faults.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
CLASSES, FAULTS = "sua", ["none", "blank", "duplicate", "truncated"]
TERMINALS = 16
#: States from which a turn of the class can follow, by class, and the state then reached.
BEFORE = {0: [EMPTY], 1: [EMPTY, SYSTEM, ASSISTANT], 2: [USER]}
LEGAL = {(0, 1), (1, 2), (2, 1)}
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Insertions before a turn: from state, to state, how many.
INSERTED = [(s, s, 0) for s in range(4)] + [(EMPTY, USER, 1), (SYSTEM, USER, 1), (ASSISTANT, USER, 1), (USER, ASSISTANT, 1), (EMPTY, ASSISTANT, 2), (SYSTEM, ASSISTANT, 2)]
#: Insertions after the last turn.
CLOSING = {EMPTY: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
#: Turns of one chunk of a conversation.
SPAN = 512
MODULUS, BASE = (1 << 89) - 1, 1_000_003


class Rope:
    """A string as a tree; equal strings have equal length and hash."""

    __slots__ = ("left", "right", "text", "length", "hash", "power")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.length, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * BASE + ord(c)) % MODULUS
            self.power = pow(BASE, self.length, MODULUS)
        else:
            self.length = left.length + right.length
            self.hash = (left.hash * right.power + right.hash) % MODULUS
            self.power = left.power * right.power % MODULUS

    def __add__(self, other: Rope) -> Rope:
        return Rope(left=self, right=other)

    def same(self, other: Rope) -> bool:
        return self is other or (self.hash == other.hash and self.length == other.length)

    def __lt__(self, other: Rope) -> bool:
        """By the first difference; equal parts are passed over without a look inside."""
        if self.same(other):
            return False
        xs, ys = [self], [other]
        while xs and ys:
            x, y = xs[-1], ys[-1]
            if x.same(y):
                xs.pop()
                ys.pop()
            elif x.left is not None and (x.length >= y.length or y.left is None):
                xs[-1:] = [x.right, x.left]
            elif y.left is not None:
                ys[-1:] = [y.right, y.left]
            else:
                n = min(x.length, y.length)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                for side, leaf in ((xs, x), (ys, y)):
                    side.pop()
                    if leaf.length > n:
                        side.append(Rope(leaf.text[n:]))
        return not xs and bool(ys)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                out.append(r.text)
            else:
                todo += [r.right, r.left]
        return "".join(out)


#: A matrix: (state, state) -> (cost, audit); pairs of states that no edits join are left out.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def better(found: Matrix, cell: tuple[int, int], cost: int, audit: Rope) -> None:
    known = found.get(cell)
    if known is None or cost < known[0] or (cost == known[0] and audit < known[1]):
        found[cell] = (cost, audit)


def terminal(symbol: int) -> Matrix:
    role, fault = divmod(symbol, 4)
    edits = [(s, s, DELETE, "D") for s in range(4)]
    if FAULTS[fault] in ("none", "truncated"):
        more = TRUNCATED if FAULTS[fault] == "truncated" else 0
        if role < len(CLASSES):
            edits += [(s, role + 1, more, "K") for s in BEFORE[role]]
        edits += [(s, to + 1, RELABEL + more, "R") for to in (1, 2) for s in BEFORE[to]]
    out: Matrix = {}
    for s, m, n in INSERTED:
        for a, t, cost, letter in edits:
            if a == m:
                better(out, (s, t), INSERT * n + cost, Rope("I" * n + letter))
    return out


def product(x: Matrix, y: Matrix) -> Matrix:
    least: dict[tuple[int, int], int] = {}
    for (s, m), (c, _) in x.items():
        for t in range(4):
            if (m, t) in y:
                least[s, t] = min(least.get((s, t), 1 << 60), c + y[m, t][0])
    out: Matrix = {}
    for (s, t), cost in least.items():
        for m in range(4):
            if (s, m) in x and (m, t) in y and x[s, m][0] + y[m, t][0] == cost:
                better(out, (s, t), cost, x[s, m][1] + y[m, t][1])
    return out


class Symbols:
    """For every symbol its matrix, and (first class, last class, blank, duplicate, truncated, illegal) of the turns it stands for."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.matrix = [terminal(k) for k in range(TERMINALS)]
        self.facts = [(k // 4, k // 4, int(k % 4 == 1), int(k % 4 == 2), int(k % 4 == 3), 0) for k in range(TERMINALS)]
        for x, y in rules:
            self.matrix.append(product(self.matrix[x], self.matrix[y]))
            self.facts.append(joined(self.facts[x], self.facts[y]))

    def stretch(self, symbols: list[int], opening: bool) -> tuple[Matrix, tuple]:
        """The product over a sequence; of an opening one only what starts with nothing put out."""
        out, facts = self.matrix[symbols[0]], self.facts[symbols[0]]
        if opening:
            out = {k: v for k, v in out.items() if k[0] == EMPTY}
        for k in symbols[1:]:
            out, facts = product(out, self.matrix[k]), joined(facts, self.facts[k])
        return out, facts


def joined(x: tuple, y: tuple) -> tuple:
    return (x[0], y[1], x[2] + y[2], x[3] + y[3], x[4] + y[4], x[5] + y[5] + ((x[1], y[0]) not in LEGAL))


def damaged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a hash of conversation and turn chooses; nulls count as one space."""
    plain = turns.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("bigint").alias("turn"), *[F.coalesce(quoted(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def symbols_of(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, sequence): each conversation's turns in order as symbols, SPAN to a chunk."""
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    narrow = turns.select("conv_id", "turn", "role", digest(F.col("text")).alias("digest"), F.when(end == "", 1).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0).alias("fault"))
    rows = written(narrow.withColumn("row", F.monotonically_increasing_id()), "repair-rows")
    # The first of equal turns, where there are several.
    equal = rows.filter("fault <> 1").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal = equal.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.row").alias("first"))
    met = rows.join(equal, rows.conv_id.eqNullSafe(F.col("c")) & (rows.role == F.col("r")) & (rows.digest == F.col("d")), "left")
    fault = F.when((F.col("fault") != 1) & (F.col("first") != F.col("row")), 2).otherwise(F.col("fault"))
    role = F.substring("role", 1, 1)
    named = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    faulty = written(met.select("conv_id", "turn", "role", "digest", "row", (named * 4 + fault).alias("symbol")), "repair-faults")
    inorder = numbered(faulty, ["conv_id"], ["turn", "role", "digest", "row"], name="repair-numbers")
    chunk = ((F.col("number") - F.col("number") % SPAN) / SPAN).cast("bigint")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("number", "symbol"))), lambda s: s["symbol"])
    return inorder.groupBy("conv_id", chunk.alias("chunk")).agg(listed.alias("sequence"))


def evaluated(sequences: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """``sequences`` (sequence, opening, symbols) -> (sequence, opening, costs, audits, facts); entry states times exit states, null where none."""
    schema = StructType.fromDDL("sequence array<int>, opening boolean, costs array<bigint>, audits array<string>, facts array<bigint>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(("grammar", tuple(rules)), lambda: Symbols(rules))
        for b in batches:
            costs, audits, facts = [], [], []
            for symbols, opening in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                m, f = table.stretch(symbols, opening)
                cells = [m.get((s, t)) for s in range(1 if opening else 4) for t in range(4)]
                costs.append([None if c is None else c[0] for c in cells])
                audits.append([None if c is None else str(c[1]) for c in cells])
                facts.append(list(f))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())), pa.array(facts, pa.list_(pa.int64()))], schema.names)

    return map_arrow(sequences.select("sequence", "opening", "symbols"), read, schema)


class Path:
    """The audit of a path, chunk by chunk, from its last piece back; paths share their beginnings."""

    __slots__ = ("cost", "before", "piece")

    def __init__(self, cost: int, before: Path | None, piece: str):
        self.cost, self.before, self.piece = cost, before, piece

    def pieces(self, until: Path | None = None) -> list[str]:
        out, at = [], self
        while at is not until:
            out.append(at.piece)
            at = at.before
        return out[::-1]

    def __lt__(self, other: Path) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        x, y = self, other
        while x is not y:
            x, y = x.before, y.before
        return self.pieces(x) < other.pieces(x)


def folded(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, costs, audits, facts) -> one row per conversation: (conv_id, blank, duplicate, truncated, illegal, cost, audit).

    A conversation's chunks stream past in order. Held are the four best paths so far, which share all but their ends.
    """
    kind = chunks.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, paths, facts = None, None, None

        def finish() -> None:
            best = min(Path(p.cost + INSERT * CLOSING[t], p, "I" * CLOSING[t]) for t, p in paths.items())
            done.append((conv, *facts[2:], best.cost, "".join(best.pieces())))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(list(zip(*done)) or [[]] * 7, [own, *[pa.int64()] * 5, pa.string()])], schema.names)
            done.clear()
            return batch

        own = pa.null()
        for b in batches:
            own = b.schema.field(0).type
            for c, chunk, costs, audits, found in zip(*[x.to_pylist() for x in b.columns]):
                if chunk == 0:
                    if paths is not None:
                        finish()
                    conv, paths, facts = c, {EMPTY: Path(0, None, "")}, None
                then: dict[int, Path] = {}
                for s, p in paths.items():
                    for t in range(4):
                        if costs[4 * s + t] is not None:
                            made = Path(p.cost + costs[4 * s + t], p, audits[4 * s + t])
                            if t not in then or made < then[t]:
                                then[t] = made
                paths, facts = then, tuple(found) if facts is None else joined(facts, tuple(found))
            if done:
                yield flush()
        if paths is not None:
            finish()
            yield flush()

    return map_arrow(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "chunk", "costs", "audits", "facts"), read, schema)


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summaries(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each of ``ids`` (conv_id, distinct) over the damaged ``turns``: the columns of SUMMARY, and the audit."""
    chunks = written(symbols_of(turns).withColumn("opening", F.col("chunk") == 0), "repair-chunks")
    different = written(chunks.select("sequence", "opening").distinct().withColumn("symbols", F.col("sequence")), "repair-sequences")
    rules, short = pair_grammar(different, "symbols", TERMINALS)
    met = chunks.join(written(evaluated(short, rules), "repair-evaluated"), ["sequence", "opening"])
    found = written(folded(met), "repair-folded")
    span = turns.filter("turn is not null").groupBy("conv_id", "turn").agg(F.count("*")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    span, found = span.withColumnRenamed("conv_id", "c"), found.withColumnRenamed("conv_id", "f")
    met = ids.join(span, ids.conv_id.eqNullSafe(F.col("c")), "left").join(found, ids.conv_id.eqNullSafe(F.col("f")), "left")
    return met.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in SUMMARY], F.coalesce("audit", F.lit("")).alias("audit"))


class Walk:
    """Applies an audit to turns as they come: yields (edit, role, text) of what is put out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def put(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.state = CLASSES.index(role[0]) + 1
        return edit, role, text

    def next_role(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.put("I", self.next_role(), "")

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.put(edit, role if edit == "K" else self.next_role(), text)


def with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The damaged ``turns`` after their conversation's row of ``found``, which is the one without a digest; texts move once."""
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest(F.col("text")).alias("digest"), "text", *[F.lit(None).cast("bigint").alias(c) for c in SUMMARY])
    none = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", F.lit(0).alias("kind"), none("bigint").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), F.col("audit").alias("text"), *SUMMARY)
    both = heads.unionByName(rows)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text", *SUMMARY)


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: of the repaired ``role:text``, one line for a turn. The digest of a conversation is one chain, so its texts stream past one task."""
    schema = StructType([*found.select("conv_id", *SUMMARY, "audit").schema.fields, *StructType.fromDDL("repaired_sha256 string").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, walk, state, lines = None, None, None, 0
        own = pa.null()

        def add(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal lines
            for _, role, text in made:
                state.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1

        def finished() -> list[tuple]:
            if head is None:
                return []
            add(walk.inserted())
            return [(head[0], *head[4:], head[3], state.hexdigest())]

        for b in batches:
            own, done = b.schema.field(0).type, []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[1] == 0:
                    done += finished()
                    head, walk, state, lines = row, Walk(row[3]), hashlib.sha256(), 0
                else:
                    add(walk.turn(row[2], row[3]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*done), [own, *[pa.int64()] * 6, pa.string(), pa.string()])], schema.names)
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*finished()), [own, *[pa.int64()] * 6, pa.string(), pa.string()])], schema.names)

    return map_arrow(with_audits(turns, found), read, schema)


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position from 0, edit, role, text): the turns that the audits of ``found`` leave, relabel or insert."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, position bigint, edit string, role string, text string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, walk, position, own = None, None, 0, pa.null()
        out: list[tuple] = []

        def add(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal position
            for put in made:
                out.append((conv, position, *put))
                position += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(list(zip(*out)) or [[]] * 5, [own, pa.int64(), pa.string(), pa.string(), pa.string()])], schema.names)
            out.clear()
            return batch

        for b in batches:
            own = b.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[1] == 0:
                    if walk is not None:
                        add(walk.inserted())
                    conv, walk, position = row[0], Walk(row[3]), 0
                else:
                    add(walk.turn(row[2], row[3]))
            yield flush()
        if walk is not None:
            add(walk.inserted())
            yield flush()

    return map_arrow(with_audits(turns, found), read, schema)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns are ordered by number, none first, then by role and a digest of the text; rows equal in all are turns of their own, each but the
    first a duplicate. Rows without conv_id are one conversation. Null roles and texts count as one space; a role whose initial is not
    s, u or a cannot be kept. No task holds more than SPAN turns of a conversation, but for the audit itself, one letter a
    turn. An empty table gives no rows; extra columns are ignored.
    """
    configure(turns.sparkSession)
    plain = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return summaries(plain, turns.select("conv_id").distinct())


def damage_and_repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``repair`` of the damaged ``turns``, for every original conversation, with the digest of the repaired turns.

    Conversations that the damage leaves without a row have zeros, an empty audit and the digest of an empty string.
    """
    configure(turns.sparkSession)
    left = damaged(turns, conv_col, turn_col, role_col, text_col)
    found = written(summaries(left, turns.select(quoted(conv_col).alias("conv_id")).distinct()), "repair-summaries")
    return digests(left, found).select("conv_id", *SUMMARY, "audit", "repaired_sha256")
