"""Role repair against enumeration, over one chunk and over many."""

import itertools
import random
from collections import defaultdict

import pytest

from taxatrend.llm import chat_format
from taxatrend.llm.chat_format import ASSISTANT, NEXT, ROLES, START, Costs


def cheapest(given):
    """Least cost over all choices for each turn: (rendered role, merged, inserted role or none)."""
    costs, best = Costs(), {START: 0}
    for g in given:
        then = {}
        for s, c in best.items():
            for x, merged, y in itertools.product((1, 2, 3), (False, True), (None, 1, 2, 3)):
                legal = (merged and y is None and s == x) or (not merged and (x in NEXT[s] if y is None else y in NEXT[s] and x in NEXT[y]))
                if legal:
                    price = c + (0 if g == ROLES[x - 1] else costs.relabel[g, ROLES[x - 1]]) + costs.merge * merged + costs.insert * (y is not None)
                    then[x] = min(then.get(x, 1 << 30), price)
        best = then
    return min(c + {0: 0, 1: 6, 2: 3, 3: 0}[s] for s, c in best.items())


def legal(text):
    roles = [p.split("|>")[0] for p in text.split("<|") if p and not p.startswith("end|>")]
    state = START
    for r in roles:
        assert ROLES.index(r) + 1 in NEXT[state], roles
        state = ROLES.index(r) + 1
    assert state == ASSISTANT and text.endswith("<|end|>\n") and text.count("<|end|>") == len(roles)


@pytest.mark.parametrize("span", [256, 8])
def test_repair(spark, monkeypatch, span):
    monkeypatch.setattr(chat_format, "SPAN", span)
    rng = random.Random(span)
    rows, given = [], defaultdict(list)
    for c in range(60):
        for t in range(rng.randint(1, 9) if c else 150):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, " User"])
            rows.append((c or None, 3 * t - 5, role, rng.choice([None, "", f"text {t}"]), "x", True))
            given[c or None].append({None: "other", "tool": "other", " User": "user"}.get(role, role))
    rows += rows[-2:]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, chunk string, merged boolean")
    by = defaultdict(list)
    for r in chat_format.format_chats(df).collect():
        by[r.conv_id].append(r)
    assert set(by) == set(given)
    for c, found in by.items():
        found.sort(key=lambda r: r.position)
        assert [r.given_role for r in found] == given[c]
        assert sum(r.cost for r in found) == cheapest(given[c])
        text = "".join(r.rendered for r in found)
        legal(text)
        assert text.count("text ") == sum("text" in (r[3] or "") for r in set(rows) if r[0] == c)


def test_plain_conversation_and_none(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat_format.format_chats(df).collect(), key=lambda r: r.position)
    assert "".join(r.rendered for r in rows) == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n" and sum(r.cost for r in rows) == 0
    assert chat_format.format_chats(df.filter("turn > 5")).count() == 0


def test_null_turns_and_repeated_numbers(spark):
    df = spark.createDataFrame([(1, None, "user", "a"), (1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat_format.format_chats(df).collect(), key=lambda r: r.position)
    assert [(r.turn, r.given_role) for r in rows] == [(-1, "user"), (0, "assistant"), (0, "user")]
    legal("".join(r.rendered for r in rows))


def test_one_turn_number_for_all_rows(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SPAN", 8)
    held, group = [], chat_format.by_group
    monkeypatch.setattr(chat_format, "by_group", lambda df, keys, *rest: held.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0]) or group(df, keys, *rest))
    df = spark.createDataFrame([(None if i % 3 else 7, None if i % 2 else 4, "user", f"text {i}") for i in range(400)], "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for r in sorted(chat_format.format_chats(df).collect(), key=lambda r: r.position):
        by[r.conv_id].append(r)
    assert max(held) <= 8
    for found in by.values():
        assert [r.position for r in found] == list(range(len(found))) and [r.turn for r in found] == sorted(r.turn for r in found)
        assert sum(r.cost for r in found) == cheapest(["user"] * len(found))
        legal("".join(r.rendered for r in found))
    assert sum(map(len, by.values())) == 400


def test_turns_that_differ_only_as_given_stay(spark):
    rows = [(1, 0, "tool", "a"), (1, 0, "function", "a"), (1, None, "user", "a"), (1, -1, "user", "a"), (1, 0, "Tool", "a"), (1, 0, None, "a"), (1, 0, "tool", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(chat_format.format_chats(df).collect(), key=lambda r: r.position)
    assert [(r.turn, r.given_role) for r in found] == [(-1, "user")] * 2 + [(0, "other")] * 4
    assert [r.position for r in found] == list(range(6))
    text = "".join(r.rendered for r in found)
    legal(text)
    assert text.count("a\n\n") + text.count("a<|end|>") == 6
