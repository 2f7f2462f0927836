"""Personal data in texts: fixed rules, and spans that a character BiLSTM with a CRF adds to them.

The tagger is trained in numpy from labelled spans: those that the rules find
in a bounded sample, and the same spans written in other ways, in their own
contexts.  A text's stretches around what a span can hold are cut into
overlapping windows; the windows' scores are merged, and one path of tags is
decoded over each whole stretch, whatever its length.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: int, end: int>>"

#: Characters of a window, half of which the next one shares; of the context on both sides of what a span can hold.
WIDTH, CONTEXT = 96, 32
#: The sample: windows of each kind and without any, and the other ways of writing made of each with a span.
MAX_WINDOWS, MAX_PLAIN, VARIANTS = 400, 1200, 2
#: Size of the states, steps of the fit, windows of a step, and one in how many windows is held back.
STATES, STEPS, STEP, HELD_BACK = 16, 720, 48, 5
#: Windows whose scores are worked out at a time, characters of a block of texts.
BATCH, BLOCK = 512, 1 << 22

_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
#: White space as Python's expressions know it, also for those of Arrow.
_SPACE = "[\\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Where a span can be: each has a digit, an at sign, or the word in its place with a domain behind, as ``plausible`` asks for.
_HINT = rf"(?i)[0-9@]|[\[({{<]\s?(?:at|dot)\s?[\])}}>]|\bat\b(?:{_SPACE}*[\])}}>]{_SPACE}*|{_SPACE}+)[a-z0-9-]+(?:\.[a-z0-9-]|{_SPACE}*(?:[\[({{<]{_SPACE}*)?\bdot\b)"
_HINTS = re.compile(_HINT)


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right doubled."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return _DIGITS.sub("", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from one at sign to the next: what stands before it is read once, from its end
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at - _RUN.match(text[done:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def rules(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed rules, leftmost and apart within a kind, by start and kind; in time linear in the text."""
    out = [("email", *x) for x in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def unsure(text: str) -> bool:
    """Whether the rules drop a run of digits that is too long for one span: it may be several, which have no label then."""
    return any(len(_digits(m[0])) > 15 for m in _PHONE.finditer(text)) or any(len(_digits(m[0])) > 19 for m in _CARD.finditer(text))


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the tagger adds can be of its kind, however it is written."""
    if kind == "email":
        plain = re.sub(r"\s*[\[({<]?\s*\bat\b\s*[\])}>]?\s*", "@", re.sub(r"\s*[\[({<]?\s*\bdot\b\s*[\])}>]?\s*", ".", text, flags=re.I), flags=re.I)
        found = rules(re.sub(r"\s*@\s*", "@", plain))
        return any(k == "email" for k, _, _ in found) and "." in plain.rpartition("@")[2]
    digits = _digits(text)
    if kind == "ip":
        parts = [p for p in _DIGITS.split(text) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text around what a span can hold, with CONTEXT characters on both sides, joined where they meet."""
    out: list[list[int]] = []
    for m in _HINTS.finditer(text):
        start, end = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


#: Symbols: ASCII with one digit for all, other letters, other marks.
SYMBOLS = 130


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out = np.where(points < 128, points, np.where((points >= 0x2000) & (points < 0x3000), 129, 128))
    out[(points >= 48) & (points < 58)] = 48
    return out


#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
#: What a step that no path may take weighs: into an I from another kind or none.
NEVER = -30.0
_ALLOWED = np.array([[j % 2 == 1 or j == 0 or i in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])
_BEGINS = np.array([j % 2 == 1 or j == 0 for j in range(TAGS)])


def tags(n: int, spans: Iterable[tuple[str, int, int]]) -> np.ndarray:
    """The tags of n characters; where spans of two kinds meet, the first holds."""
    out = np.zeros(n, dtype=np.int64)
    for kind, start, end in spans:
        if not out[start:end].any():
            tag = 1 + 2 * KINDS.index(kind)
            out[start:end] = tag + 1
            out[start] = tag
    return out


def spans_of(path: np.ndarray) -> list[tuple[str, int, int]]:
    out = []
    for start in np.flatnonzero(path % 2 == 1):
        end = start + 1
        while end < len(path) and path[end] == path[start] + 1:
            end += 1
        out.append((KINDS[path[start] // 2], int(start), int(end)))
    return out


def initial(states: int = STATES, seed: int = 7) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    draw = lambda *shape: (rnd.normal(0, 1, shape) / np.sqrt(shape[0] if len(shape) > 1 and shape[0] != SYMBOLS else 4)).astype(np.float32)
    p = {"in_f": draw(SYMBOLS, 4 * states) * 0.5, "in_b": draw(SYMBOLS, 4 * states) * 0.5, "rec_f": draw(states, 4 * states), "rec_b": draw(states, 4 * states), "out_f": draw(states, TAGS), "out_b": draw(states, TAGS)}
    for d in "fb":
        p[f"in_{d}"][:, states : 2 * states] += 1  # states are kept at first
    return p | {"bias": np.zeros(TAGS, np.float32), "step": np.where(_ALLOWED, 0, NEVER).astype(np.float32), "begin": np.where(_BEGINS, 0, NEVER).astype(np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(ids: np.ndarray, there: np.ndarray, table: np.ndarray, rec: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """States (characters, windows, states) in ``order``; padding leaves none."""
    n, states = ids.shape[0], rec.shape[0]
    h = c = np.zeros((n, states), dtype=rec.dtype)
    out = np.empty((ids.shape[1], n, states), dtype=rec.dtype)
    for t in order:
        z = table[ids[:, t]] + h @ rec
        i, f, o = _sigmoid(z[:, :states]), _sigmoid(z[:, states : 2 * states]), _sigmoid(z[:, 3 * states :])
        g = np.tanh(z[:, 2 * states : 3 * states])
        own = there[:, t, None]
        new = (f * c + i * g) * own
        s = np.tanh(new)
        if keep is not None:
            keep.append((t, h, c, i, f, g, o, s, own))
        c, h = new, o * s * own
        out[t] = h
    return out


def _lstm_back(ids: np.ndarray, rec: np.ndarray, keep: list, grad: np.ndarray, d_table: np.ndarray, d_rec: np.ndarray) -> None:
    dh = dc = np.zeros_like(keep[0][1])
    for t, h, c, i, f, g, o, s, own in reversed(keep):
        dh = (dh + grad[t]) * own
        dc = (dc + dh * o * (1 - s * s)) * own
        dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), dh * s * o * (1 - o)), axis=1)
        np.add.at(d_table, ids[:, t], dz)
        d_rec += h.T @ dz
        dh, dc = dz @ rec.T, dc * f


def emissions(p: dict[str, np.ndarray], ids: np.ndarray, there: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (characters, windows, tags) of windows (windows, characters), and the states of both directions."""
    n = ids.shape[1]
    forth = _lstm(ids, there, p["in_f"], p["rec_f"], range(n), keep and keep[0])
    back = _lstm(ids, there, p["in_b"], p["rec_b"], range(n - 1, -1, -1), keep and keep[1])
    return forth @ p["out_f"] + back @ p["out_b"] + p["bias"], forth, back


def loss(p: dict[str, np.ndarray], ids: np.ndarray, there: np.ndarray, truth: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> float:
    """Mean negative log-likelihood of the tags (windows, characters); ``grads`` gets its gradients added."""
    keep = ([], []) if grads is not None else None
    scores, forth, back = emissions(p, ids, there, keep)
    n, length = ids.shape
    rows, real = np.arange(n), there.astype(bool)
    log = lambda x: np.log(np.maximum(x, np.finfo(x.dtype).tiny))
    step = np.exp(p["step"])
    alpha = np.empty_like(scores)
    alpha[0] = p["begin"] + scores[0]
    for t in range(1, length):
        top = alpha[t - 1].max(axis=1, keepdims=True)
        new = log(np.exp(alpha[t - 1] - top) @ step) + top + scores[t]
        alpha[t] = np.where(real[:, t, None], new, alpha[t - 1])
    top = alpha[-1].max(axis=1, keepdims=True)
    total = (np.log(np.exp(alpha[-1] - top).sum(axis=1, keepdims=True)) + top)[:, 0]
    right = p["begin"][truth[:, 0]] + scores[0][rows, truth[:, 0]]
    for t in range(1, length):
        right = right + np.where(real[:, t], p["step"][truth[:, t - 1], truth[:, t]] + scores[t][rows, truth[:, t]], 0)
    if grads is None:
        return float((total - right).mean())
    beta = np.zeros_like(scores[0])
    d_scores = np.empty_like(scores)
    for t in range(length - 1, -1, -1):
        own = np.exp(alpha[t] + beta - total[:, None]) * real[:, t, None]
        d_scores[t] = own
        d_scores[t][rows[real[:, t]], truth[real[:, t], t]] -= 1
        if t:
            ahead = scores[t] + beta
            top = ahead.max(axis=1, keepdims=True)
            before = alpha[t - 1].max(axis=1, keepdims=True)
            weight = np.exp(np.minimum(before + top - total[:, None], 60)) * real[:, t, None]
            near, far = np.exp(alpha[t - 1] - before), np.exp(ahead - top)
            grads["step"] += (near * weight).T @ far * step
            np.add.at(grads["step"], (truth[real[:, t], t - 1], truth[real[:, t], t]), -1)
            beta = np.where(real[:, t, None], log(far @ step.T) + top, beta)
    grads["begin"] += d_scores[0].sum(axis=0)
    grads["bias"] += d_scores.sum(axis=(0, 1))
    for d, states, k in (("f", forth, keep[0]), ("b", back, keep[1])):
        grads[f"out_{d}"] += np.einsum("tbs,tbk->sk", states, d_scores, optimize=True)
        _lstm_back(ids, p[f"rec_{d}"], k, d_scores @ p[f"out_{d}"].T, grads[f"in_{d}"], grads[f"rec_{d}"])
    for g in grads.values():
        g /= n
    return float((total - right).mean())


def padded(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.zeros((len(texts), width), dtype=np.int64)
    there = np.zeros((len(texts), width), dtype=np.float32)
    for i, x in enumerate(texts):
        ids[i, : len(x)], there[i, : len(x)] = x, 1
    return ids, there


def train(texts: list[np.ndarray], truth: list[np.ndarray], most: int = STEPS, states: int = STATES, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam; windows of like lengths make a step."""
    p, rnd = initial(states, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    order = np.argsort([len(x) for x in texts], kind="stable")
    steps = [order[k : k + STEP] for k in range(0, len(order), STEP)]
    passes = -(-most // max(1, len(steps)))
    done, all_ = 0, max(1, passes * len(steps))
    for _ in range(passes):
        for k in rnd.permutation(len(steps)):
            own = steps[k]
            width = max(len(texts[i]) for i in own)
            ids, there = padded([texts[i] for i in own], width)
            right, _ = padded([truth[i] for i in own], width)
            grads = {n: np.zeros_like(v) for n, v in p.items()}
            loss(p, ids, there, right, grads)
            grads["step"][~_ALLOWED] = 0
            grads["begin"][~_BEGINS] = 0
            scale = min(1.0, 5.0 / (1e-12 + float(np.sqrt(sum((g * g).sum() for g in grads.values())))))
            done += 1
            now = rate * (1 - 0.9 * done / all_)
            for n, g in grads.items():
                g = g * scale
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                p[n] = p[n] - now * (first[n] / (1 - 0.9**done)) / (np.sqrt(second[n] / (1 - 0.99**done)) + 1e-6)
    return p


def merged(p: dict[str, np.ndarray], ids: np.ndarray) -> Iterator[np.ndarray]:
    """Scores of one stretch, block after block: where two windows meet, each weighs more towards its middle."""
    half = WIDTH // 2
    weight = np.minimum(np.arange(WIDTH) + 1, WIDTH - np.arange(WIDTH)).astype(np.float32)[:, None]
    starts = range(0, max(1, len(ids) - half), half)
    left = None  # what the window before says of the half it shares with the next
    for k in range(0, len(starts), BATCH):
        own = starts[k : k + BATCH]
        block, there = padded([ids[s : s + WIDTH] for s in own], min(WIDTH, len(ids)))
        scores = emissions(p, block, there)[0]
        for i, s in enumerate(own):
            size = min(WIDTH, len(ids) - s)
            e = scores[:size, i]
            if left is not None:
                e[:half] = (e[:half] * weight[:half] + left * weight[half:]) / (weight[:half] + weight[half:])
            last = s + size >= len(ids)
            yield e if last else e[:half]
            left = e[half:].copy() if not last else None


def decode(p: dict[str, np.ndarray], blocks: Iterator[np.ndarray], caution: float) -> np.ndarray:
    """The best path of tags over scores (characters, tags) that come in blocks; ``caution`` is what a span costs."""
    came: list[np.ndarray] = []
    best = None
    for block in blocks:
        block = block.copy()
        block[:, 1::2] -= caution
        back = np.empty(block.shape, dtype=np.int8)
        for t, e in enumerate(block):
            if best is None:
                best = p["begin"] + e
                continue
            ways = best[:, None] + p["step"]
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + e
        came.append(back)
    back = np.concatenate(came)
    path = np.empty(len(back), dtype=np.int64)
    tag = int(best.argmax())
    for t in range(len(back) - 1, -1, -1):
        path[t] = tag
        tag = int(back[t, tag]) if t else tag
    return path


def decode_many(p: dict[str, np.ndarray], scores: np.ndarray, sizes: np.ndarray, caution: float) -> list[np.ndarray]:
    """The best path of each of many short stretches: scores (characters, stretches, tags)."""
    scores = scores.copy()
    scores[:, :, 1::2] -= caution
    n = scores.shape[1]
    best, back = p["begin"] + scores[0], np.empty(scores.shape, dtype=np.int8)
    for t in range(1, len(scores)):
        ways = best[:, :, None] + p["step"]
        back[t] = ways.argmax(axis=1)
        new = ways.max(axis=1) + scores[t]
        best = np.where((t < sizes)[:, None], new, best)
    path = np.zeros((n, len(scores)), dtype=np.int64)
    tag, rows = best.argmax(axis=1), np.arange(n)
    for t in range(len(scores) - 1, -1, -1):
        inside = t < sizes
        path[:, t] = np.where(inside, tag, 0)
        if t:
            tag = np.where(inside, back[t, rows, tag], tag)
    return [path[i, :s] for i, s in enumerate(sizes)]


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    #: What each span costs, as the held-back windows ask for.
    caution: float


_EDGE = " \t\r\n\f\v.,;:-"


def added(model: Model, texts: list[tuple[str, list[tuple[int, int]], list[tuple[str, int, int]]]]) -> list[list[tuple[str, int, int]]]:
    """The spans that the tagger adds to each (text, stretches, spans of the rules): plausible ones that meet none of the rules."""
    where = [(k, a, b) for k, (_, parts, _) in enumerate(texts) for a, b in parts]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    paths: dict[int, np.ndarray] = {}
    short = sorted((i for i, (_, a, b) in enumerate(where) if b - a <= WIDTH), key=lambda i: where[i][2] - where[i][1])
    for k in range(0, len(short), BATCH):
        own = short[k : k + BATCH]
        coded = [symbols(texts[w][0][a:b]) for w, a, b in (where[i] for i in own)]
        sizes = np.array([len(x) for x in coded])
        ids, there = padded(coded, int(sizes.max()))
        paths |= zip(own, decode_many(model.weights, emissions(model.weights, ids, there)[0], sizes, model.caution))
    for i, (w, a, b) in enumerate(where):
        path = paths[i] if i in paths else decode(model.weights, merged(model.weights, symbols(texts[w][0][a:b])), model.caution)
        text, _, ruled = texts[w]
        starts = [s for _, s, _ in ruled]
        reach = list(np.maximum.accumulate([e for _, _, e in ruled])) if ruled else []
        for kind, start, end in spans_of(path):
            start, end = start + a, end + a
            piece = text[start:end]
            start, end = start + len(piece) - len(piece.lstrip(_EDGE)), end - (len(piece) - len(piece.rstrip(_EDGE)))
            before = bisect_left(starts, end)
            cut = text[max(0, start - 1) : start] + text[end : end + 1]  # no part of a longer number
            if start < end and not (before and reach[before - 1] > start) and not (kind != "email" and re.search("[0-9]", cut)) and plausible(kind, text[start:end]):
                out[w].append((kind, start, end))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the texts with the rules' spans: (text, kind, spans), no span cut."""
    for batch in batches:
        for text in _hinted(batch["text"])[1]:
            found = rules(text)
            rows = []
            for a, b in stretches(text):
                for s in range(a, max(a + 1, b - WIDTH // 2), WIDTH // 2):
                    e = min(b, s + WIDTH)
                    own = [(k, x - s, y - s) for k, x, y in found if x < e and y > s]
                    if all(x >= 0 and y <= e - s for _, x, y in own) and not unsure(text[max(0, s - 20) : e + 20]):
                        rows.append((text[s:e], own[0][0] if own else "none", [dict(kind=k, start=x, end=y) for k, x, y in own]))
            for k in range(0, len(rows), 10_000):
                w, kind, spans = zip(*rows[k : k + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(kind), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=["window", "kind", "spans"])


def _hinted(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Places and texts of those in which a span can be."""
    hit = pc.fill_null(pc.match_substring_regex(texts, _HINT), False)
    at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
    return at, texts.take(pa.array(at)).to_pylist()


def _other_digits(text: str, rnd: random.Random) -> str:
    return re.sub(r"[0-9]", lambda _: str(rnd.randrange(10)), text)


def _card(n: int, rnd: random.Random) -> str:
    digits = _other_digits("0" * (n - 1), rnd)
    return digits + next(d for d in "0123456789" if luhn(digits + d))


def rewritten(kind: str, text: str, rnd: random.Random) -> str:
    """A span's text in another way that the rules may miss."""
    if kind == "email":
        name, _, host = text.rpartition("@")
        name = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and rnd.random() < 0.7 else c for c in name)
        at = rnd.choice([" at ", " [at] ", "[at]", "(at)", " (at) ", " AT ", " @ "])
        dot = rnd.choice([" dot ", "[dot]", " [dot] ", "(dot)", " (dot) "]) if rnd.random() < 0.6 and at != " @ " else "."
        return _other_digits(name, rnd) + at + host.replace(".", dot)
    if kind == "ip":
        return rnd.choice(["[.]", "(.)", " . ", "[dot]"]).join(str(rnd.randrange(256)) for _ in range(4))
    if kind == "card":
        digits = _card(len(_digits(text)), rnd)
        return rnd.choice([".", "/", "  ", "_", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c, cc = (_other_digits("0" * n, rnd) for n in (3, 3, 4, rnd.choice([1, 2])))
    return rnd.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "00{cc} {a} {b} {c}", "{cc}-{a}-{b}-{c}", "{cc} ({a}) {b}-{c}", "({a}){b}-{c}", "{a} {b}-{c}", "+{cc}/{a}/{b}{c}"]).format(a=a, b=b, c=c, cc=cc)


def ordinary(rnd: random.Random) -> str:
    """Digits and at signs that are no personal data."""
    n = lambda k: _other_digits("0" * k, rnd)
    y, m, d = 1950 + rnd.randrange(90), 1 + rnd.randrange(12), 1 + rnd.randrange(28)
    return rnd.choice([f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{d:02}/{m:02}/{y}", f"{y}-{m:02}-{d:02} {n(2)}:{n(2)}:{n(2)}", f"{n(2)}:{n(2)}", f"version {n(1)}.{n(1)}.{n(2)}", f"v{n(1)}.{n(1)}", n(rnd.randrange(1, 25)), f"{n(1)},{n(3)},{n(3)}.{n(2)}", f"${n(3)}.{n(2)}", f"{n(3)}-{n(4)}", f"pages {n(3)}-{n(3)}", f"{y}-{y + 1}", f"ISBN {n(3)}-{n(1)}-{n(5)}-{n(3)}-{n(1)}", "@" + rnd.choice(["home", "user", "work", "noon"]), f"at {n(1)} o'clock", "meet at the dot", f"{n(2)}%", f"#{n(5)}", f"{n(4)} {n(4)}", f"10^{n(2)}", f"id={n(8)}", f"0x{n(8)}", f"{n(1)}.{n(3)}.{n(3)}.{n(3)},{n(2)}"])


def variant(text: str, spans: list[tuple[str, int, int]], rnd: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A window with its spans, and ordinary digits, written in other ways; spans that meet others make it as it was."""
    out, new, at = "", [], 0
    for kind, start, end in spans:
        if start < at:
            return text, spans
        out += text[at:start]
        way, at = rnd.random(), end
        if way < 0.25:
            out += ordinary(rnd)
        elif way < 0.45 and kind != "email":  # several spans side by side, which the rules take for one number
            pieces = [("phone", _other_digits("+1 (000) 000-0000", rnd)), ("card", _card(16, rnd)), ("ip", ".".join(str(rnd.randrange(256)) for _ in range(4)))]
            for other, piece in rnd.sample(pieces, 2):
                new.append((other, len(out), len(out) + len(piece)))
                out += piece + " "
            out = out[:-1]
        else:
            piece = rewritten(kind, text[start:end], rnd)
            new.append((kind, len(out), len(out) + len(piece)))
            out += piece
    return out + text[at:], new


def fit(docs: DataFrame, most: int = MAX_WINDOWS, plain: int = MAX_PLAIN) -> Model:
    """A tagger from the labelled spans in ``text`` of a bounded sample of windows, the first by a hash; every fifth is held back.

    The held-back windows set ``caution``: the least with which spans are added
    to one of 500 of them at most.  Without windows (an empty table, no text with a
    digit) the tagger adds nothing.
    """
    seen = docs.select("text").mapInArrow(_windows, f"window string, kind string, spans {SPANS}").dropDuplicates(["window"])
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("window"), "window"))
    kept = seen.withColumn("_place", place).where(F.col("_place") <= F.when(F.col("kind") == "none", plain).otherwise(most))
    rows = sorted((r["kind"], r["_place"], r["window"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in kept.collect())
    rnd = random.Random(11)
    held = [(w, s) for _, k, w, s in rows if k % HELD_BACK == 0]
    sample = []
    for _, k, w, s in rows:
        if k % HELD_BACK:
            sample.append((w, s))
            for _ in range(VARIANTS if s else 1):
                if not s and len(w) > 8:  # ordinary digits in the middle of a plain one
                    middle = rnd.randrange(1, len(w))
                    w2 = w[:middle] + " " + ordinary(rnd) + " " + w[middle:]
                    sample.append((w2, s) if not rules(w2) else (w, s))
                elif s:
                    sample.append(variant(w, s, rnd))
    if not sample or not any(s for _, s in sample):
        return Model(initial(), 1e4)
    weights = train([symbols(w) for w, _ in sample], [tags(len(w), s) for w, s in sample])
    return Model(weights, _caution(weights, held + [(w, s) for w, s in sample if not s][: len(held)]))


def _caution(weights: dict[str, np.ndarray], windows: list[tuple[str, list[tuple[str, int, int]]]]) -> float:
    """The least of some steps with which one of 500 windows at most gets more than its spans."""
    cases = [(w, [(0, len(w))], s) for w, s in windows if w]
    for caution in (1.0, 1.5, 2.0, 3.0, 4.0, 6.0):
        if sum(map(bool, added(Model(weights, caution), cases))) * 500 <= len(cases):
            return caution
    return 8.0


def find(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ruled`` and ``found``: the rules' spans, and all, by start and kind, in code points, the end exclusive.

    A null or empty text has none.  Rows each are judged by themselves, so
    repeated rows get the same.  A text of any length is read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [dict(kind=k, start=s, end=e) for k, s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["_text"]
            ruled: list = [[] for _ in range(batch.num_rows)]
            found = list(ruled)
            at, texts = _hinted(own)
            cases: list[tuple[int, tuple]] = []
            size = 0
            for n, (i, text) in enumerate(zip(at, texts)):
                cases.append((i, (text, stretches(text), rules(text))))
                size += len(text)
                if size >= BLOCK or n == len(at) - 1:
                    for (i, (_, _, base)), more in zip(cases, added(sent.value, [c for _, c in cases])):
                        ruled[i] = as_rows(base)
                        found[i] = as_rows(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))) if more else ruled[i]
                    cases, size = [], 0
            columns = [batch[f"_{k}"] for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ruled, kind), pa.array(found, kind)], names=[*keep, "ruled", "found"])

    named = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)], F.col("text").alias("_text"))
    return named.mapInArrow(run, ", ".join([*fields, f"ruled {SPANS}", f"found {SPANS}"]))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (by start) as its kind in brackets; of spans that overlap, the first."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
