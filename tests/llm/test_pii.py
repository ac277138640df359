"""Base spans against the plain patterns, the field's dynamic programmes against enumeration, and defined cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from taxatrend.llm import pii
from taxatrend.llm.queries import QUERIES


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(1)
    for letters in ("a@.-1 +()0", "1.25@", "0123456789 -", "+1 (2).3-", "a1@b.c%_+ ٣é"):
        for _ in range(3000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "1 " * 20_000):
        pii.base_spans(t)


def test_dynamic_programmes_against_enumeration(monkeypatch):
    monkeypatch.setattr(pii, "LONGEST", 2)
    rng = np.random.default_rng(0)
    n, segs = 4, pii.segments(4)
    scores, moves = rng.normal(size=(len(segs), pii.STATES)) + pii.barred(segs), rng.normal(size=(pii.STATES, pii.STATES))
    where, found = {s: k for k, s in enumerate(segs)}, []
    for cuts in itertools.product([0, 1], repeat=n - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
        parts = list(zip([0, *ends[:-1]], ends))
        if all(p in where for p in parts):
            for ys in itertools.product(range(pii.STATES), repeat=len(parts)):
                path = [(where[p], y) for p, y in zip(parts, ys)]
                found.append((sum(scores[k, y] for k, y in path) + sum(moves[a, b] for a, b in zip((0, *ys), ys)), path))
    values = np.array([v for v, _ in found])
    total, each, moved = pii.posterior(scores, segs, moves, n)
    assert np.isclose(total, np.logaddexp.reduce(values))
    want, steps = np.zeros_like(scores), np.zeros_like(moves)
    for v, path in found:
        last = 0
        for k, y in path:
            want[k, y] += np.exp(v - total)
            steps[last, y] += np.exp(v - total)
            last = y
    assert np.allclose(each, want) and np.allclose(moved, steps)
    assert pii.best_path(scores, segs, moves, n) == max(found)[1]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        d = [rng.randint(1, 9) for _ in range(15)]
        card = next("".join(map(str, [*d, c])) for c in range(10) if pii.luhn("".join(map(str, [*d, c]))))
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        parts = [f"word{'' if i % 2 else 's'}", f"u{i}.x@mail{i % 9}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, phone, "plain", f"in {1900 + i} there"]
        rng.shuffle(parts)
        rows.append((i, " and ".join(parts), "a", [1]))
    rows += [(900, None, "a", None), (901, "", "a", None), (902, "x " * 60_000, "a", None), (902, "x " * 60_000, "a", None), (903, "call +1 (212) 555-1234 4111111111111111 now", "b", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, `base.x` array<int>")


def test_find_and_mask(docs):
    field = pii.train(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.find(docs, field).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base, spans = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert base == brute(texts[r.doc_id]) and set(base) <= set(spans)
        if r.doc_id < 903:
            assert spans == base  # nothing is added to clean words and years
    by_id = {r.doc_id: [texts[903][s.start : s.end] for s in r.spans] for r in rows if r.doc_id == 903}
    assert by_id[903] == ["+1 (212) 555-1234", "4111111111111111"]  # the patterns run them together and drop both
    masked = {r.doc_id: r.text for r in pii.mask(docs, field).collect()}
    assert masked[903] == "call <phone> <card> now" and masked[900] is None and masked[902] == texts[902]
    assert all("@" not in (t or "") for t in masked.values()) and pii.mask(docs, field).columns == docs.columns


def test_long_tokens_and_long_runs(docs):
    """A sign behind any number of characters without a blank, and a span over any place of a long run of numbers."""
    field = pii.train(docs)
    found = lambda t: {(k, t[a:b]) for k, a, b in pii.added_spans(t, pii.base_spans(t), field)}
    plain = found("write to me [at] host.com today")
    assert plain == {("email", "me [at] host.com")}
    for junk in ("x" * 100, "日本語" * 60, "=" * 200, "é" * 5000):
        got = found(f"{junk}me[at]host.com")
        assert len(got) == 1 and all(k == "email" and "me[at]host.com" in s for k, s in got), (junk[:3], got)
    hits = 0
    for before in range(0, 140, 3):
        t = " ".join(["12"] * before + ["(212) 555-1234"] + ["7"] * 80)
        hits += ("phone", "(212) 555-1234") in found(t)
    alone = ("phone", "(212) 555-1234") in found("12 12 (212) 555-1234 7 7")
    assert hits >= (40 if alone else 0)


def test_runs_of_any_length_are_segmented_alike(docs, monkeypatch):
    """Windows give what one segmentation of the whole run gives."""
    field = pii.train(docs)
    rng = random.Random(5)
    for _ in range(20):
        t = " ".join(rng.choice(["12", "(212) 555-1234", "1999", "212-555-1234", "7"]) for _ in range(150))
        got = pii.added_spans(t, pii.base_spans(t), field)
        monkeypatch.setattr(pii, "RUN", 10_000)
        whole = pii.added_spans(t, pii.base_spans(t), field)
        monkeypatch.undo()
        assert len(set(got) ^ set(whole)) <= 0.02 * len(whole) + 1


def test_islands_take_linear_time():
    for t in ("a1" * 300_000, "1 " * 100_000, "[at]" * 50_000, "1" * 500_000, "é1" * 200_000):
        assert all(b - a <= pii.MAX_TOKEN for run in pii.islands(t) for a, b in run)


def test_nothing_to_learn_from(docs):
    none = docs.filter("doc_id between 900 and 902")
    assert pii.train(none) is None
    assert all(not r.spans for r in pii.find(none, None).collect()) and pii.find(docs.filter("doc_id < 0"), None).count() == 0


def test_digests(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op4_pii"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(",") if r.spans else [])
