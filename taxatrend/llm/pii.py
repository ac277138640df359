"""Personal data: fixed base patterns, and more spans from a semi-Markov conditional random field.

The base patterns are the rules of the task. Around digits and at-signs the text is cut into tokens; a semi-Markov CRF
scores whole candidate segments of up to six tokens by features of the whole span (how many digits, in which groups,
check digit, dotted domain, ...) and a dynamic programme over segment ends chooses boundaries and kinds jointly, base
spans held fixed. It is trained on base spans of a bounded sample of documents, on their customary rewritings (a phone
number without its plus, an address with a bracketed "at") and on near misses, which stay unlabelled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatrend.llm.common import configure, fresh, map_arrow, quoted, whole_text

KINDS = ["email", "ip", "card", "phone"]
#: Tokens a segment may have, and documents the model is trained on.
LONGEST, SAMPLE = 6, 3_000
#: Characters about the signs of one of them that are learnt from.
CHARACTERS = 20_000
#: Posterior that a segment needs to be added.
SURE = 0.9

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in even))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match ends at an at-sign's domain and starts as far left as its local part reaches: linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each run of dotted numbers."""
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind in the order of KINDS."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *s) for s in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- tokens and features -------------------------------------------------------------------------------------------

#: What marks a token that may belong to a span: a digit, an at-sign, or a bracketed "at" or "dot".
SIGN = re.compile(r"[0-9@]|[\[({](?:[aA][tT]|[dD][oO][tT])[\])}]")
MAX_TOKEN = 80
REST = re.compile(r"\S{0,%d}" % (MAX_TOKEN + 1))
BEFORE, AFTER = re.compile(r"(\S{1,80})[ \t]$"), re.compile(r"[ \t](\S{1,80})")
TRIM_LEFT, TRIM_RIGHT = "\"'<[{,;:!?", "\"'>]},;:!?."
AT, DOT = re.compile(r"\s*[\[({]at[\])}]\s*|\s*@\s*", re.IGNORECASE), re.compile(r"\s*[\[({]dot[\])}]\s*", re.IGNORECASE)
BRACKETED = re.compile(r"[\[({](?:at|dot)[\])}]", re.IGNORECASE)
#: Of a token longer than MAX_TOKEN the characters of this kind about a sign are taken, so many on either side.
CORE, NEAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@()[]{}"), 37
#: Tokens of a longer run that are segmented at once, and the tokens on either side that are segmented with them.
RUN, AROUND = 64, 10


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens with signs, with one plain token before and after each bracketed or bare sign.

    A token without a blank for MAX_TOKEN characters is cut at changes of the kind of its characters, and near its signs.
    """
    runs: list[list[tuple[int, int]]] = []
    m, done = SIGN.search(text), 0
    while m:
        start, end = m.start(), REST.match(text, m.end()).end()
        while start > done and m.start() - start <= MAX_TOKEN and not text[start - 1].isspace():
            start -= 1
        if end - start > MAX_TOKEN:
            start, end = m.span()
            while start > done and m.start() - start < NEAR and text[start - 1] in CORE:
                start -= 1
            while end < len(text) and end - m.end() < NEAR and text[end] in CORE:
                end += 1
        tokens, done = [(start, end)], end
        m = SIGN.search(text, end)
        word = text[start : min(end, start + MAX_TOKEN)]
        if word == "@" or BRACKETED.search(word):
            before, after = BEFORE.search(text[max(0, start - 82) : start]), AFTER.match(text, end)
            if before:
                tokens.insert(0, (start - 1 - len(before[1]), start - 1))
            if after:
                tokens.append(after.span(1))
        for t in tokens:
            if runs and t[0] < runs[-1][-1][1]:
                continue
            if runs and t[0] - runs[-1][-1][1] <= 1:
                runs[-1].append(t)
            else:
                runs.append([t])
    out = []
    for run in runs:
        trimmed = []
        for a, b in run:
            if b - a <= MAX_TOKEN:
                s = text[a:b]
                left = len(s) - len(s.lstrip(TRIM_LEFT)) if not BRACKETED.match(s) else 0
                right = len(s.rstrip(TRIM_RIGHT)) if not BRACKETED.search(s[-6:]) else len(s)
                if left < right:
                    trimmed.append((a + left, a + right))
        if trimmed:
            out.append(trimmed)
    return out


def span_features(s: str) -> list[float]:
    """Features of a whole candidate span."""
    digits = DIGIT.findall(s)
    n = len(digits)
    groups = re.findall("[0-9]+", s)
    shape = tuple(map(len, groups))
    letters = sum(c.isalpha() for c in s)
    four = len(groups) == 4 and re.fullmatch(r"[0-9.]+", s) is not None
    mended = DOT.sub(".", AT.sub("@", s))
    m = re.fullmatch(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})", mended)
    checked = 14 <= n <= 19 and luhn("".join(digits))
    numeric = re.fullmatch(r"[+(]?[0-9][0-9 ().-]*", s) is not None
    return [
        1.0, float(" " in s), s.count(" ") / 3, float(n == 0), float(1 <= n <= 6), float(7 <= n <= 9), float(n == 10), float(n == 11), float(12 <= n <= 13), float(14 <= n <= 19), float(n > 19),
        float(m is not None), float(m is not None and " " in s), float("@" in s), float(BRACKETED.search(s) is not None), float(checked and numeric), float(14 <= n <= 19 and not checked),
        float(four and all(int(g[-4:]) <= 255 and len(g) <= 3 for g in groups)), float(four and not all(int(g[-4:]) <= 255 and len(g) <= 3 for g in groups)),
        float(s[0] == "+"), float(s[0] == "("), float(shape[-3:] == (3, 3, 4)), float(shape == (1, 3, 3, 4)), float(shape == (4, 4, 4, 4)), float(numeric), float(letters > 0), letters / len(s),
        float("/" in s), float(":" in s), float("," in s), float("=" in s), float(re.fullmatch(r"[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}", s) is not None), float(len(groups) == 1), float(len(groups) == 2), len(s) / 40,
    ]


WIDTH = len(span_features("1"))


# --- the field -----------------------------------------------------------------------------------------------------

STATES = len(KINDS) + 1  # 0: outside, always one token long


def segments(n: int) -> list[tuple[int, int]]:
    return [(i, j) for j in range(1, n + 1) for i in range(max(0, j - LONGEST), j)]


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # states x features
    moves: np.ndarray  # state before x state

    def table(self, text: str, tokens: list[tuple[int, int]]) -> np.ndarray:
        return np.array([span_features(text[tokens[i][0] : tokens[j - 1][1]]) for i, j in segments(len(tokens))])


def posterior(scores: np.ndarray, segs: list[tuple[int, int]], moves: np.ndarray, n: int) -> tuple[float, np.ndarray, np.ndarray]:
    """log Z, each segment's posterior by state, and expected moves. ``scores``: segments x states, -inf where barred."""
    into = [[k for k, (_, j) in enumerate(segs) if j == e] for e in range(n + 1)]
    outof = [[k for k, (i, _) in enumerate(segs) if i == s] for s in range(n + 1)]
    peak = lambda x: np.logaddexp.reduce(x, axis=0)
    fore = np.full((n + 1, STATES), -np.inf)
    fore[0, 0] = 0.0
    enter = np.full((n + 1, STATES), -np.inf)  # all paths up to a place, with the move into the next state
    enter[0] = fore[0, 0] + moves[0]
    for e in range(1, n + 1):
        fore[e] = peak(np.array([enter[segs[k][0]] + scores[k] for k in into[e]]))
        enter[e] = peak(fore[e][:, None] + moves)
    back = np.full((n + 1, STATES), -np.inf)  # of all paths on from a place, by the state that ended there
    back[n] = 0.0
    onward = np.full((n + 1, STATES), -np.inf)
    for s in range(n - 1, -1, -1):
        onward[s] = peak(np.array([scores[k] + back[segs[k][1]] for k in outof[s]]))
        back[s] = peak((moves + onward[s][None, :]).T)
    total = peak(fore[n])
    each = np.array([enter[i] + scores[k] + back[j] for k, (i, j) in enumerate(segs)]) - total
    moved = np.exp(moves[0] + onward[0] - total)[None, :] * (np.arange(STATES) == 0)[:, None]
    for s in range(1, n):
        moved = moved + np.exp(fore[s][:, None] + moves + onward[s][None, :] - total)
    return float(total), np.exp(each), moved


def barred(segs: list[tuple[int, int]]) -> np.ndarray:
    """Outside segments are one token long."""
    b = np.zeros((len(segs), STATES))
    b[[k for k, (i, j) in enumerate(segs) if j - i > 1], 0] = -np.inf
    return b


def fit(examples: list[tuple[np.ndarray, int, list[tuple[int, int, int]]]], steps: int = 80, ridge: float = 0.02) -> Field:
    """``examples``: (segment features, tokens, labelled (i, j, state)) -> the field, by likelihood (Adam)."""
    w, t = np.zeros((STATES, WIDTH)), np.zeros((STATES, STATES))
    state = [np.zeros_like(x) for x in (w, t, w, t)]
    plans = []
    for x, n, spans in examples:
        segs = segments(n)
        index = {s: k for k, s in enumerate(segs)}
        path, at = [], 0
        for i, j, y in sorted(spans):
            path += [(p, p + 1, 0) for p in range(at, i)] + [(i, j, y)]
            at = j
        path += [(p, p + 1, 0) for p in range(at, n)]
        gold = np.zeros((len(segs), STATES))
        moved, last = np.zeros((STATES, STATES)), 0
        for i, j, y in path:
            gold[index[i, j], y] = 1
            moved[last, y] += 1
            last = y
        plans.append((x, n, segs, barred(segs), gold, moved))
    for step in range(1, steps + 1):
        gw, gt = -ridge * w * len(plans) / 100, -ridge * t * len(plans) / 100
        for x, n, segs, bar, gold, moved in plans:
            _, each, seen = posterior(x @ w.T + bar, segs, t, n)
            gw = gw + (gold - each).T @ x
            gt = gt + moved - seen
        for k, (v, g) in enumerate(((w, gw / len(plans)), (t, gt / len(plans)))):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 2] = 0.999 * state[k + 2] + 0.001 * g * g
            v += 0.3 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 2] / (1 - 0.999**step)) + 1e-8)
    return Field(w, t)


def examples_of(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """Islands of a text with the base spans that fill whole tokens."""
    spans = base_spans(text)
    for tokens in (run[at : at + RUN] for run in islands(text) for at in range(0, len(run), RUN)):
        starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        labelled, free = [], 0
        for kind, a, b in spans:
            if a in starts and b in ends and ends[b] - starts[a] <= LONGEST and starts[a] >= free:
                labelled.append((starts[a], ends[b], KINDS.index(kind) + 1))
                free = ends[b]
        inside = [(a, b) for k, a, b in spans if a < tokens[-1][1] and b > tokens[0][0]]
        if all(any(a <= tokens[i][0] and tokens[j - 1][1] <= b for i, j, _ in labelled) for a, b in inside):
            yield text, labelled, tokens


def rewritten(kind: str, s: str, k: int) -> str | None:
    """A customary rewriting of a base span that is still personal data; None where there is none."""
    if kind == "phone":
        digits = "".join(DIGIT.findall(s))[-10:]
        return [f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}"][k % 3] if len(digits) == 10 else None
    if kind == "email":
        user, host = s.split("@")
        return [f"{user} [at] {host}", f"{user} (at) {host.replace('.', ' (dot) ', 1)}" if host.count(".") == 1 else f"{user} (at) {host}", f"{user} @ {host}"][k % 3]
    return None


def near_miss(kind: str, s: str, k: int) -> str | None:
    """The span spoilt so that it is none any more."""
    if kind == "ip":
        return s.rpartition(".")[0] + f".{256 + k % 700}"
    if kind == "card":
        last = next(i for i in range(len(s) - 1, -1, -1) if s[i].isdigit())
        return s[:last] + str((int(s[last]) + 1 + k % 8) % 10) + s[last + 1 :]
    if kind == "email":
        return [s.partition("@")[0], s.partition("@")[2], s.partition("@")[0] + "@"][k % 3]
    return "".join(DIGIT.findall(s))[: 3 + k % 6]


#: Digits in ordinary use, for texts that lack them: fixed examples of what stays unlabelled.
PLAIN_NUMBERS = ["12", "1999", "2.0", "3.1.4", "2021-03-04", "4/5/2020", "12:30", "1,250", "3.", "10%", "v2.5.1", "555-2485", "978-3-16-148410-0", "1 000 000", "AB-1234", "120.50", "x1", "5 6 7", "1990-1995", "@", "@home"]


def learn(texts: list[str], most: int = 700) -> Field | None:
    """The field from base spans, rewritings and near misses of the texts; None if no text has a base span."""
    real, made = [], []
    for text in texts:
        for t, labelled, tokens in examples_of(text):
            real.append((t, labelled, tokens))
        for k, (kind, a, b) in enumerate(base_spans(text)):
            before, after = text[max(0, a - 30) : a], text[b : b + 30]
            if (new := rewritten(kind, text[a:b], len(made) + k)) is not None:
                made.append((before + new + after, len(before), len(before) + len(new), KINDS.index(kind) + 1))
            if (new := near_miss(kind, text[a:b], len(made) + k)) is not None:
                made.append((before + new + after, len(before), len(before) + len(new), 0))
    if not any(labelled for _, labelled, _ in real):
        return None
    rng = np.random.default_rng(0)
    pick = lambda xs: [xs[i] for i in rng.permutation(len(xs))[:most]]
    field, found = Field(np.zeros((STATES, WIDTH)), np.zeros((STATES, STATES))), []
    for text, labelled, tokens in pick(real):
        found.append((field.table(text, tokens), len(tokens), labelled))
    for text, a, b, y in pick(made):
        for tokens in islands(text):
            if tokens[0][0] < b and tokens[-1][1] > a:
                i = next((i for i, t in enumerate(tokens) if t[0] == a), None)
                j = next((j + 1 for j, t in enumerate(tokens) if t[1] == b), None)
                if y and i is not None and j is not None and 0 < j - i <= LONGEST:
                    found.append((field.table(text, tokens), len(tokens), [(i, j, y)]))
                elif not y and not base_spans(text[tokens[0][0] : tokens[-1][1]]):
                    found.append((field.table(text, tokens), len(tokens), []))
    for s in PLAIN_NUMBERS:
        text = f"words {s} words"
        found += [(field.table(text, tokens), len(tokens), []) for tokens in islands(text)] * 5
    return fit(found)


def segmented(text: str, tokens: list[tuple[int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans of the best segmentation of a run, those nearly certain, window by window.

    A window decides on the spans that begin in it, with the tokens around it in view, which are more than a span can have; the next window begins
    behind the last of its spans.
    """
    out, at = [], 0
    while at < len(tokens):
        start, until = max(0, at - AROUND), min(at + RUN, len(tokens))
        window = tokens[start : until + AROUND]
        segs = segments(len(window))
        scores = field.table(text, window) @ field.weights.T + barred(segs)
        _, each, _ = posterior(scores, segs, field.moves, len(window))
        for k, y in best_path(scores, segs, field.moves, len(window)):
            i, j = segs[k]
            if y and at <= start + i < until and each[k, y] >= SURE:
                out.append((KINDS[y - 1], window[i][0], window[j - 1][1]))
                until = max(until, start + j)
        at = until
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Spans of the best segmentation beyond the base ones: none overlaps a base span, each nearly certain."""
    out = []
    for tokens in islands(text):
        # Base spans split an island: they stay as they are, and so do all tokens they touch.
        pieces: list[list[tuple[int, int]]] = [[]]
        for a, b, own in touched(tokens, base):
            if own:
                pieces.append([])
            else:
                pieces[-1].append((a, b))
        for piece in filter(None, pieces):
            out += segmented(text, piece, field)
    return [s for s, (_, _, own) in zip(out, touched([(a, b) for _, a, b in out], base)) if not own]


def touched(tokens: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """Each token, in order, with whether a base span overlaps it."""
    spans = sorted((a, b) for _, a, b in base)
    reach = list(accumulate((b for _, b in spans), max))
    starts = [a for a, _ in spans]
    for a, b in tokens:
        before = bisect_left(starts, b)
        yield a, b, before > 0 and reach[before - 1] > a


def best_path(scores: np.ndarray, segs: list[tuple[int, int]], moves: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The best segmentation: (segment, state) from left to right."""
    best = np.full((n + 1, STATES), -np.inf)
    best[0, 0] = 0.0
    came: dict[tuple[int, int], tuple[int, int]] = {}
    for k, (i, j) in enumerate(segs):  # by end
        via = best[i][:, None] + moves
        value, before = via.max(axis=0) + scores[k], via.argmax(axis=0)
        for y in np.flatnonzero(value > best[j]):
            best[j, y] = value[y]
            came[j, int(y)] = (k, int(before[y]))
    at, y, path = n, int(best[n].argmax()), []
    while at:
        k, before = came[at, y]
        path.append((k, y))
        at, y = segs[k][0], before
    return path[::-1]


# --- over DataFrames -----------------------------------------------------------------------------------------------


def train(docs: DataFrame, text_col: str = "text", most: int = SAMPLE) -> Field | None:
    """Learn from at most ``most`` documents with a digit or an at-sign (those with the smallest hashes), CHARACTERS around the signs of each at most, drawn over its whole text."""
    configure(docs.sparkSession)
    rows = docs.select(whole_text(quoted(text_col)).alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                cut, end = [], -1
                for run in islands(t):
                    a, z = max(run[0][0] - 40, end), run[-1][1] + 40
                    if z > end:
                        cut.append(t[a:z])
                        end = z
                # Stretches are drawn over the whole text, up to a number of characters.
                order = np.random.default_rng(len(t)).permutation(len(cut))
                room = np.cumsum([len(cut[i]) + 1 for i in order]) <= CHARACTERS
                out.append("\n".join(cut[i] for i in np.sort(order[room])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    chosen = map_arrow(rows, around, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(most)
    return learn(sorted(r.text for r in chosen.collect()))


def find(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end), the base spans and all spans.

    Offsets are code points, end exclusive, in order of start and then kind as in KINDS. Null text has no spans; whole texts are read, tokens of any length
    in them; rows that repeat are searched each by itself. Columns named base or spans are replaced, all others pass through. Without a trained field ``spans`` is ``base``.
    """
    configure(docs.sparkSession)
    (text,) = fresh(docs, "text_to_search")
    rest = [quoted(c) for c in docs.columns if c not in ("base", "spans")]
    rows = docs.select(*rest, whole_text(quoted(text_col)).alias(text))
    width = len(rest)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    spark_kind = rows.sparkSession.createDataFrame([], "s array<struct<kind:string,start:bigint,end:bigint>>").schema["s"].dataType
    schema = type(rows.schema)(list(rows.schema.fields[:-1])).add("base", spark_kind).add("spans", spark_kind)
    as_dicts = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, full = [], []
            for t in b.column(width).to_pylist():
                own = base_spans(t)
                more = added_spans(t, own, field) if field is not None else []
                base.append(as_dicts(own))
                full.append(as_dicts(sorted(own + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(base, span), pa.array(full, span)], [*b.schema.names[:width], "base", "spans"])

    return map_arrow(rows, read, schema)


def mask(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in angle brackets; overlapping spans are one, named by the first.

    A text without spans stays as it is, null stays null; all columns keep their places.
    """
    configure(docs.sparkSession)
    at = docs.columns.index(text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    base = base_spans(t)
                    spans = sorted(base + (added_spans(t, base, field) if field is not None else []), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                    parts, done = [], 0
                    for kind, a, z in spans:
                        if a >= done:
                            parts.append(t[done:a] + f"<{kind}>")
                        done = max(done, z)
                    t = "".join(parts) + t[done:]
                out.append(t)
            columns = list(b.columns)
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_arrow(docs, read, docs.schema)
