"""Conversation repair against a search over all edits, over one chunk and over many, with and without damage."""

import random
import re
import zlib
from collections import defaultdict
from functools import cache
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from taxatrend.llm import conversation_repair
from taxatrend.llm.conversation_repair import Rope, damage_and_repair, damaged, repair, repaired_turns
from taxatrend.llm.pair_grammar import pair_grammar

FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit) by trying every edit, from the end; up to three insertions in a row."""
    marks = faults(rows)

    @cache
    def best(i, state, inserted):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, ""))
        if inserted < 3:
            ways += [(c + 5, "I" + a) for to in FOLLOWS[state].replace("s", "") for c, a in [best(i, to, inserted + 1)]]
        if i < len(rows):
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if marks[i] in ("", "truncated"):
                more = 5 if marks[i] else 0
                role = rows[i][0][:1]
                if role and role in FOLLOWS[state]:
                    c, a = best(i + 1, role, 0)
                    ways.append((c + more, "K" + a))
                for to in "ua":
                    if to in FOLLOWS[state]:
                        c, a = best(i + 1, to, 0)
                        ways.append((c + more + 1, "R" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def applied(rows, audit):
    out, rows = [], iter(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else next(rows)
        after = "assistant" if out and out[-1][0][0] == "u" else "user"
        if e != "D":
            out.append((role if e == "K" else after, "" if e == "I" else text))
    return out


def checked(rows, r):
    marks = faults(rows)
    assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(k) for k in ("blank", "duplicate", "truncated"))
    assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    assert (r.cost, r.audit) == cheapest(rows)


def made(rng, n):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "unit"]
    return [(rng.choice(roles), rng.choice(["", " \n", "yes.", "no", "Why?!", "it ends. ", "cut", "é", "日本。"]) + rng.choice(["", "", f"{rng.random():.3f}."])) for _ in range(n)]


@pytest.mark.parametrize("span", [512, 4])
def test_repair(spark, monkeypatch, span):
    monkeypatch.setattr(conversation_repair, "SPAN", span)
    rng = random.Random(span)
    rows = {c or None: made(rng, rng.randint(1, 12) if c else 120) for c in range(80)}
    rows[200] = rows[7]
    df = spark.createDataFrame([(c, t, role, text, "x", 1) for c, all_ in rows.items() for t, (role, text) in enumerate(all_)], "conv_id int, turn int, role string, text string, audit string, kind int")
    found = repair(df.repartition(3)).cache()
    for r in found.collect():
        checked(rows[r.conv_id], r)
        assert r.gaps == 0
    put = defaultdict(list)
    for r in sorted(repaired_turns(df.select("conv_id", F.col("turn").cast("bigint"), "role", "text"), found).collect(), key=lambda r: r.position):
        put[r.conv_id].append((r.role, r.text))
    for r in found.collect():
        assert put[r.conv_id] == applied(rows[r.conv_id], r.audit)


def test_damage(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), role if role else None, text if text != "no" else None) for role, text in made(rng, 300)]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(77, 0, "user", "x"), (78, 5, "user", "gone")]
    want, ids = defaultdict(list), {r[0] for r in rows}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}".encode()
        role, text, kind = role or " ", " " if text is None else text, zlib.crc32(key) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = damage_and_repair(df).collect()
    assert {r.conv_id for r in got} == ids and len(got) == len(ids)
    for r in got:
        own = sorted(want[r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0))
        turns = [t for t, _, _ in own if t is not None]
        checked([x[1:] for x in own], r)
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.repaired_sha256 == sha256("\n".join(f"{a}:{b}" for a, b in applied([x[1:] for x in own], r.audit)).encode()).hexdigest()
    assert damaged(df, "conv_id", "turn", "role", "text").count() == sum(map(len, want.values()))


def test_none_left_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "x")], "conv_id long, turn long, role string, text string")
    (r,) = damage_and_repair(df).collect()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert damage_and_repair(df.filter("turn < 0")).count() == 0


def test_repeated_turn_of_one_conversation(spark):
    df = spark.createDataFrame([(None, 4, "user", "same.")] * 3000 + [(None, None, "assistant", "first " * 100_000)], "conv_id long, turn long, role string, text string")
    (r,) = repair(df).collect()
    assert (r.gaps, r.duplicate, r.truncated, r.illegal) == (0, 2999, 1, 2999) and r.audit == "D" * 3001


def test_ropes_compare_as_strings():
    rng = random.Random(1)

    def rope(text):
        if len(text) < 2 or rng.random() < 0.3:
            return Rope(text)
        k = rng.randint(1, len(text) - 1)
        return rope(text[:k]) + rope(text[k:])

    texts = ["".join(rng.choices("DIK", k=rng.randint(0, 8))) for _ in range(200)]
    for a, b in zip(texts, texts[1:]):
        assert (rope(a) < rope(b)) == (a < b) and not rope(a) < rope(a) and str(rope(a)) == a


def test_grammar_gives_back_the_sequences(spark, tmp_path):
    rng = random.Random(2)
    lists = [[rng.choice([1, 2, 2, 3]) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    spark.createDataFrame(list(enumerate(lists)), "id int, s array<int>").write.parquet(str(tmp_path / "s"))
    rules, short = pair_grammar(spark.read.parquet(str(tmp_path / "s")), "s", 4, most=40, at_once=8)

    def expand(k):
        return [k] if k < 4 else [x for half in rules[k - 4] for x in expand(half)]

    rows = {r.id: r.s for r in short.collect()}
    assert 10 < len(rules) <= 40 and sum(map(len, rows.values())) < sum(map(len, lists)) / 2
    assert all([x for k in rows[i] for x in expand(k)] == s for i, s in enumerate(lists))
