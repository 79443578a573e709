"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
Beside them, a semi-Markov field reads the stretches of a text that have
digits, at-signs or a spelled-out "at" with a dot after it: it scores candidate segments of up to ``LONGEST`` chunks
with features of the whole segment (shape, number of digits, check digit,
separators), and a dynamic programme over segments of bounded length chooses
boundaries and types together. It is trained on stretches of a bounded sample
of documents, labelled by the base patterns, and on variants of them that the
patterns miss (spelled-out at-signs and dots, other separators). What it adds
must not touch a base span and must be certain (marginal of the segment).

Offsets are code points, end exclusive. Defined results: a null text is
empty; rows are read one by one, also repeated ones; a text without digits,
at-signs and spelled-out ones has no spans; an empty table gives no rows; without any base span in
the sample the field adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, load_documents, raw, share, stored

KINDS = ("email", "ip", "card", "phone")
#: A segment has at most so many chunks; a piece that is trained on has so many.
LONGEST, STRETCH = 8, 64
#: The field is trained on the stretches of at most so many documents.
SAMPLE = 3000
#: Each base span of the sample is rewritten in so many forms.
SHOWN = 3
#: The field's spans need this marginal probability.
CERTAIN = 0.8

Span = tuple[int, int, int]  # kind's number, start, end

# The base patterns. Possessive repeats and the look-behind keep
# the scan linear and match what plain greedy repeats match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All spans of the base patterns, by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            left = max(end, text.rfind("@", 0, at) + 1)
            start = at
            while start > left and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, end := m.end()))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# The field.

_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Digits, at-signs, and "at" before a chunk with a dot or before "dot" a few chunks on.
_LIVE = re.compile(r"""[0-9@]|[(\[{<]at[)\]}>]|(?<![^\x20\x09-\x0D])at(?=[\x20\x09-\x0D]{1,2}(?:
    [^\x20\x09-\x0D]*?(?:[(\[{<]dot[)\]}>]|[A-Z0-9-]\.[A-Z])
    |(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]{1,2}){1,3}(?:dot(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]*?[(\[{<]dot[)\]}>])))""", re.I | re.X)
_AT = re.compile(r"@|[(\[{<]at[)\]}>]|(?<![^\s])at(?![^\s])", re.I)
_DOT = re.compile(r"[(\[{<](?:dot|\.)[)\]}>]|\.|(?<![^\s])dot(?![^\s])", re.I)
_OCTETS = re.compile(r"[0-9]{1,3}(?:\s*(?:\.|,|[(\[{<](?:dot|\.)[)\]}>]|\bdot\b)\s*[0-9]{1,3}){3}", re.I)
_GROUPS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9\s().+/\-]*[0-9]")
_TRIM_LEFT, _TRIM_RIGHT = " \t\n\r\v\f\"'`,;:!?.)]}>#*$%&|=~_^/\\-", " \t\n\r\v\f\"'`,;:!?.([{<#*$%&|=~_^/\\-+"
_ADDRESS = re.compile(r"[A-Z0-9._%+-]++(?:\s*+(?:@|[(\[{<]at[)\]}>])\s*+|\s++at\s++)[A-Z0-9-]++(?:(?:\s*+(?:\.|[(\[{<]dot[)\]}>])\s*+|\s++dot\s++)[A-Z0-9-]++)++", re.I)
_GOES_ON = re.compile(r"\s+(?:dot(?!\S)|[(\[{<]dot[)\]}>])", re.I)
_WORDS = {"at", "dot", "@", "."}
#: Such words join what lies so many chunks from them; one chunk more may belong to it.
_JOIN = 3


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Runs of live chunks, and what may join them: "at", "dot" and their signs
    a few chunks from a live chunk or from another such word, with one chunk
    on either side of each. A run has any length."""
    live = {m.start() for m in _LIVE.finditer(text)}
    out: list[list[tuple[int, int]]] = []
    for chunks, first in _near_chunks(text, sorted(live)):
        words = [text[a:b].strip("()[]{}<>").lower() in _WORDS or text[a:b] in _WORDS for a, b in chunks]
        anchors, keep = list(first), list(first)
        for order in (range(len(chunks)), range(len(chunks) - 1, -1, -1)):
            last = None
            for i in order:
                if words[i] and last is not None and abs(i - last) <= _JOIN:
                    anchors[i] = True
                if anchors[i]:
                    last = i
        for i, w in enumerate(words):
            if w and anchors[i]:
                for j in range(max(0, i - 1), min(len(chunks), i + 2)):
                    keep[j] = True
        last = -2
        for i, k in enumerate(keep):
            if k:
                if i == last + 1 and chunks[i][0] - chunks[i - 1][1] <= 2:
                    out[-1].append(chunks[i])
                else:
                    out.append([chunks[i]])
                last = i
    return out


def _near_chunks(text: str, live: list[int]) -> Iterator[tuple[list[tuple[int, int]], list[bool]]]:
    """Windows of chunks, each with whether it is live: those around every live
    place, as far as words join them; windows that touch are one."""
    x, end = 0, 0
    while x < len(live):
        chunks: list[tuple[int, int]] = []
        place, left = live[x], _JOIN + 1
        while place > end and text[place - 1] not in " \t\n\r\v\f":
            place -= 1
        begin = place
        while left and begin > end:
            b = begin
            while b > end and text[b - 1] in " \t\n\r\v\f":
                b -= 1
            a = b
            while a > end and text[a - 1] not in " \t\n\r\v\f":
                a -= 1
            if a == b:
                break
            left = _JOIN + 1 if text[a:b].strip("()[]{}<>").lower() in _WORDS or text[a:b] in _WORDS else left - 1
            begin = a
        first: list[bool] = []
        left = 2 * (_JOIN + 1)  # so far may two windows lie apart and still touch
        for m in _CHUNK.finditer(text, begin):
            if not left:
                break
            a, end = m.span()
            chunks.append((a, end))
            here = False
            while x < len(live) and live[x] < end:
                here, x = True, x + 1
            first.append(here)
            if here or text[a:end].strip("()[]{}<>").lower() in _WORDS or text[a:end] in _WORDS:
                left = 2 * (_JOIN + 1)
            elif a >= place:
                left -= 1
        yield chunks, first


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _TRIM_LEFT:
        a += 1
    while b > a and text[b - 1] in _TRIM_RIGHT:
        b -= 1
    return a, b


N_FEATURES = 28


def segment_features(text: str, a: int, b: int, n_chunks: int) -> list[float]:
    """Features of a whole candidate segment."""
    s = text[a:b]
    groups = _GROUPS.findall(s)
    lengths = [len(g) for g in groups]
    n = sum(lengths)
    seps = [x for x in re.split(r"[0-9]+", s)[1:-1]]
    letters = sum(c.isalpha() for c in s)
    ats, dots = len(_AT.findall(s)), len(_DOT.findall(s))
    octets = bool(_OCTETS.fullmatch(s)) and all(int(g) <= 255 for g in groups)
    number = bool(_NUMBER.fullmatch(s))
    plus = s.startswith("+")
    head, _, tail = s.partition("@") if "@" in s else ("", "", "")
    return [
        1.0, float(n_chunks == 1), n_chunks / LONGEST, float(number), float(octets), float(plus and number),
        float(number and 8 <= n <= 15), float(number and 16 <= n <= 19), float(number and 16 <= n <= 19 and luhn("".join(groups))),
        float(n == 0), min(n, 24) / 24, min(letters, 40) / 40, float(letters == 0), float(ats == 1), float(ats > 1),
        float(ats == 1 and dots >= 1), float(ats == 1 and dots >= 1 and bool(letters)), min(dots, 6) / 6, float("(" in s or ")" in s),
        float(bool(head) and bool(tail)), float(number and len(groups) >= 3), float(any(c in s for c in "\"=$#*%&|{}<>!")),
        float(number and lengths[-3:] == [3, 3, 4] and len(lengths) <= 4 and sum(lengths[:-3]) <= 3),
        float(number and lengths[-2:] == [3, 4] and n == 10), float(number and lengths == [4] * len(lengths) and 16 <= n <= 20),
        float(octets and len({*seps}) == 1), float(n_chunks > 1 and letters > 0 and not ats),
        float(bool(_ADDRESS.fullmatch(s)) and not _GOES_ON.match(text, b)),
    ]


@dataclass
class Field:
    """Weights by type: row 0 for chunks outside, then one row for each kind."""

    weights: np.ndarray


def candidates(text: str, chunks: list[tuple[int, int]], first: int = 0, last: int | None = None) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """All segments of a stretch that begin at chunk ``first`` or later and before
    ``last``, as (first chunk, chunk after, start, end), and their features."""
    segments, rows, done = [], [], [np.zeros((0, N_FEATURES))]
    for i in range(first, len(chunks) if last is None else last):
        for j in range(i + 1, min(len(chunks), i + LONGEST) + 1):
            a, b = trimmed(text, chunks[i][0], chunks[j - 1][1])
            if a >= chunks[i][1] or b <= chunks[j - 1][0] or a >= b:
                if j > i + 1:
                    continue
                a, b = chunks[i]
            segments.append((i, j, a, b))
            rows.append(segment_features(text, a, b, j - i))
        if len(rows) > 4096:
            done.append(np.array(rows))
            rows = []
    return segments, np.concatenate([*done, np.array(rows).reshape(-1, N_FEATURES)])


def _scores(rows: np.ndarray, segments: list[tuple[int, int, int, int]], weights: np.ndarray) -> np.ndarray:
    """(segment, type); outside has one chunk."""
    out = rows @ weights.T
    out[[s[1] - s[0] > 1 for s in segments], 0] = -np.inf
    return out


def _log_add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


def _forward_backward(n: int, segments: list[tuple[int, int, int, int]], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition and the marginal of every segment and type."""
    peak = np.max(scores, axis=1)
    total = (peak + np.log(np.exp(scores - peak[:, None]).sum(1))).tolist()
    alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    alpha[0] = beta[n] = 0.0
    for (i, j, _, _), s in zip(segments, total):
        alpha[j] = _log_add(alpha[j], alpha[i] + s)
    for (i, j, _, _), s in zip(reversed(segments), reversed(total)):
        beta[i] = _log_add(beta[i], beta[j] + s)
    outer = np.array([alpha[i] + beta[j] for i, j, _, _ in segments]) - alpha[n]
    return float(alpha[n]), np.exp(outer[:, None] + scores)


def _labelled(text: str, chunks: list[tuple[int, int]], gold: dict[tuple[int, int], int]):
    """A stretch's segments, their features, and which segments and types the labels choose."""
    segments, rows = candidates(text, chunks)
    truth = np.zeros((len(segments), len(KINDS) + 1))
    covered: set[int] = set()
    for x, (i, j, a, b) in enumerate(segments):
        if (a, b) in gold and not covered & set(range(i, j)):
            truth[x, gold[a, b] + 1] = 1
            covered |= set(range(i, j))
    for x, (i, j, _, _) in enumerate(segments):
        if j == i + 1 and i not in covered:
            truth[x, 0] = 1
    return segments, rows, truth


class _Batch:
    """Stretches of one number of chunks, whose sums over segmentations are made together."""

    def __init__(self, n: int, prepared: list) -> None:
        self.n, self.size = n, len(prepared)
        self.rows = np.concatenate([rows for _, rows, _ in prepared])
        self.goal = sum(truth.T @ rows for _, rows, truth in prepared)
        at = np.concatenate([np.array([(e, i, j) for i, j, _, _ in segments], np.int64) for e, (segments, _, _) in enumerate(prepared)])
        self.e, self.i, self.j = at.T
        self.long = self.j - self.i > 1

    def expected(self, w: np.ndarray) -> np.ndarray:
        """Sums of features that the weights expect."""
        scores = self.rows @ w.T
        scores[self.long, 0] = -np.inf
        peak = scores.max(1)
        total = np.full((self.size, self.n, LONGEST), -np.inf)
        total[self.e, self.i, self.j - self.i - 1] = peak + np.log(np.exp(scores - peak[:, None]).sum(1))
        alpha, beta = np.full((self.size, self.n + 1), -np.inf), np.full((self.size, self.n + 1), -np.inf)
        alpha[:, 0] = beta[:, self.n] = 0
        for j in range(1, self.n + 1):
            alpha[:, j] = np.logaddexp.reduce([alpha[:, j - k] + total[:, j - k, k - 1] for k in range(1, min(LONGEST, j) + 1)])
        for i in range(self.n - 1, -1, -1):
            beta[:, i] = np.logaddexp.reduce([beta[:, i + k] + total[:, i, k - 1] for k in range(1, min(LONGEST, self.n - i) + 1)])
        outer = alpha[self.e, self.i] + beta[self.e, self.j] - alpha[self.e, self.n]
        return np.exp(outer[:, None] + scores).T @ self.rows


def train(examples: list[tuple[str, list[Span]]], rounds: int = 150, rate: float = 1.0, decay: float = 3e-4) -> Field | None:
    """Gradient ascent (with momentum of squares) on the log-likelihood of the
    segmentations. Long stretches are trained on in parts of ``STRETCH`` chunks."""
    prepared: dict[int, list] = {}
    for text, spans in examples:
        gold = {(a, b): k for k, a, b in spans}
        for run in stretches(text):
            for c in range(0, len(run), STRETCH):
                chunks = run[c : c + STRETCH]
                prepared.setdefault(len(chunks), []).append(_labelled(text, chunks, gold))
    batches = [_Batch(n, some) for n, some in sorted(prepared.items())]
    if not any(b.goal[1:].any() for b in batches):
        return None
    w = np.zeros((len(KINDS) + 1, N_FEATURES))
    seen = np.full_like(w, 1e-8)
    goal, size = sum(b.goal for b in batches), sum(b.size for b in batches)
    for _ in range(rounds):
        grad = (goal - sum(b.expected(w) for b in batches)) / size - decay * w
        seen += grad * grad
        w += rate * grad / np.sqrt(seen)
    return Field(w)


class _Apart:
    """Whether a range touches none of some spans; linear in them once, then by search."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __call__(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return not at or self.ends[at - 1] <= a


#: Segments that begin at so many chunks have their features made together.
PIECE = 512


def _scored(text: str, chunks: list[tuple[int, int]], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: segments, the logarithm of the sum over types, the best type and its score."""
    for low in range(0, len(chunks), PIECE):
        segments, rows = candidates(text, chunks, low, min(low + PIECE, len(chunks)))
        scores = _scores(rows, segments, weights)
        peak = scores.max(1)
        kind = scores.argmax(1)
        yield np.array(segments, np.int32), peak + np.log(np.exp(scores - peak[:, None]).sum(1)), kind.astype(np.int8), scores[np.arange(len(kind)), kind]


def field_spans(text: str, base: list[Span], field: Field | None) -> list[Span]:
    """Spans that the field adds: of the best segmentation, certain, apart from
    base spans. Of a long stretch only a few numbers a segment are held; sums
    are carried over from piece to piece, forward and backward."""
    if field is None:
        return []
    out: list[Span] = []
    apart = _Apart(base)
    for chunks in stretches(text):
        if not any(apart(a, b) for a, b in chunks):
            continue
        n = len(chunks)
        pieces, none = [], [-math.inf]
        alpha, best, back, back_piece = array("d", none * (n + 1)), array("d", none * (n + 1)), array("i", [0] * (n + 1)), array("i", [0] * (n + 1))
        alpha[0] = best[0] = 0.0
        for p, (segments, total, kind, score) in enumerate(_scored(text, chunks, field.weights)):
            for x, (i, j, s, v) in enumerate(zip(segments[:, 0].tolist(), segments[:, 1].tolist(), total.tolist(), score.tolist())):
                alpha[j] = _log_add(alpha[j], alpha[i] + s)
                if best[i] + v > best[j]:
                    best[j], back[j], back_piece[j] = best[i] + v, x, p
            pieces.append((segments, total, kind, score))
        chosen, at = [], n
        while at:
            segments, _, kind, score = pieces[back_piece[at]]
            x = back[at]
            i, _, a, b = segments[x].tolist()
            if kind[x] and apart(a, b):
                chosen.append((int(kind[x]), i, at, a, b, float(score[x])))
            at = i
        if not chosen:
            continue
        beta = array("d", none * n + [0.0])
        for segments, total, _, _ in reversed(pieces):
            for i, j, s in zip(segments[::-1, 0].tolist(), segments[::-1, 1].tolist(), total[::-1].tolist()):
                beta[i] = _log_add(beta[i], beta[j] + s)
        out += [(k - 1, a, b) for k, i, j, a, b, v in chosen if math.exp(alpha[i] + v + beta[j] - alpha[n]) >= CERTAIN]
    return out


#: Ways to write what the base patterns find so that they miss it.
FORMS = {
    0: [(" at ", " dot "), (" (at) ", " (dot) "), (" at ", "."), (" @ ", " . "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", ".")],
    1: ["[.]", " . ", " dot ", "(dot)"],
    2: [".", "/", "  ", "_"],
    3: ["{0}.{1}.{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "+1.{0}.{1}.{2}", "({0}) {1} {2}"],
}


def rewritten(span: str, kind: int, form: int) -> str | None:
    """``span`` in one of its kind's ``FORMS``; None if nothing changes, or if it is more than a segment then."""
    d, how = _digits(span), FORMS[kind][form]
    if kind == 0:
        name, _, domain = span.partition("@")
        new = name + how[0] + domain.replace(".", how[1])
    elif kind == 1:
        new = span.replace(".", how)
    elif kind == 2:
        new = how.join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        new = how.format(d[-10:-7], d[-7:-4], d[-4:]) if len(d) >= 10 else span
    return new if new != span and len(new.split()) <= LONGEST else None


def rewrite(text: str, spans: list[Span], chosen: Span, form: int) -> tuple[str, list[Span]] | None:
    """The text with one span rewritten, and all spans where they then are."""
    k, a, b = chosen
    new = rewritten(text[a:b], k, form)
    if new is None:
        return None
    shift = len(new) - (b - a)
    moved = [(q, x + shift * (x >= b), y + shift * (y >= b)) for q, x, y in spans if (q, x, y) != chosen and (y <= a or x >= b)]
    return text[:a] + new + text[b:], [*moved, (k, a, a + len(new))]


def variants(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]] | None:
    """The text with one span rewritten in a way that the base patterns miss."""
    if not spans:
        return None
    chosen = rng.choice(spans)
    return rewrite(text, spans, chosen, rng.randrange(len(FORMS[chosen[0]])))


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 42) -> Field | None:
    """The field, from a bounded sample of stretches: ``sample`` of all kinds,
    one a document, and half as many that hold base spans, those with the
    smallest hashes. They are cut out on the executors with a little around
    them; a part of a stretch of 2,000 characters or more is left out of the
    sample. Every base span is also shown in ``SHOWN`` of its ``FORMS``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, out, with_spans = [], [], []
            for b in batch.column("raw").to_pylist():
                text = b.decode("utf-8", "replace")
                runs = stretches(text)
                if not runs:
                    continue
                digest = int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big", signed=True)
                pieces = [r[i : i + STRETCH] for r in runs for i in range(0, len(r), STRETCH)]
                apart = _Apart(base_spans(text))
                some = [r for r in pieces if not all(apart(a, b) for a, b in r)]
                for k, choice in ((False, pieces), (True, some)):
                    if choice:
                        run = choice[digest % len(choice)]
                        a, e = max(0, run[0][0] - 30), min(len(text), run[-1][1] + 30)
                        if e - a < 2000:
                            order.append(digest)
                            out.append(text[a:e])
                            with_spans.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(out, pa.string()), pa.array(with_spans, pa.bool_())], names=["at", "cut", "some"])

    cuts = stored(docs.select(raw("text").alias("raw")).mapInArrow(cut, "at long, cut string, some boolean"), "pii-cuts")
    texts: set[str] = set()
    for some, n in ((False, sample), (True, sample // 2)):
        texts |= {r.cut for r in cuts.where(F.col("some") == some).orderBy("at", "cut").limit(n).collect()}
    return train(shown(sorted(texts), random.Random(seed)))


def shown(texts: list[str], rng: random.Random) -> list[tuple[str, list[Span]]]:
    """Examples: the texts with their base spans, and one text for each span and form that is drawn."""
    examples = []
    for text in texts:
        spans = base_spans(text)
        examples.append((text, spans))
        for chosen in rng.sample(spans, min(len(spans), 4)):
            forms = len(FORMS[chosen[0]])
            examples += [e for f in rng.sample(range(forms), min(forms, SHOWN)) if (e := rewrite(text, spans, chosen, f)) is not None]
    return examples


def all_spans(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind, then start."""
    base = base_spans(text)
    return base, sorted({*base, *field_spans(text, base, field)})


def personal_data(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans."""
    shared = share(docs.sparkSession, field)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [], [], []
            for b in batch.column("raw").to_pylist():
                base, found = all_spans(b.decode("utf-8", "replace"), shared.value)
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            columns = [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", raw("text").alias("raw")).mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """Every span, or joint stretch of spans, becomes its kind in brackets."""
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``n_chars``, where
    there is one, counts the new text. A null text stays null."""
    shared = share(docs.sparkSession, field)
    name = free_name(docs.columns, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for b in batch.column(name).to_pylist():
                text = None if b is None else b.decode("utf-8", "replace")
                found = all_spans(text, shared.value)[1] if text else []
                texts.append(redacted(text, found) if found else text)
            at = batch.schema.names.index("text")
            yield batch.drop_columns([name]).set_column(at, batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    out = docs.withColumn(name, F.col("text").cast("binary")).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", length)
    return out.select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    return personal_data(docs, fit(docs))
