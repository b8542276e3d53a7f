"""Personal data: base patterns and a linear-chain conditional random field over word shapes.

Base spans come from four patterns read leftmost and without overlap, each in time linear in the text. The field labels
white-space tokens with O or a kind, from features of the token's shape and of its neighbours' shapes. It is trained
from a small labelled table (labelled_tokens(), made by rule) by gradient ascent on the penalised likelihood, and decoded
by Viterbi in numpy over many runs of tokens at once. A token without digit, @ or + can only be O, so a text falls into
runs of tokens that may be personal data, each decoded exactly between its O neighbours, whose shapes count as they do in
training. Tokens also end at commas, semicolons and bars, so lists without spaces are tokens side by side; no token is left
out, and no added span goes over a separator. Spans of the field that touch no base span are added; base spans stay.

Texts are independent: one pass of Arrow batches over the scan, no shuffle. Time is linear in a text. Runs are decoded in
groups of bounded size; of a run beyond that only five numbers a token are held, its label scores. Defined results: a null text is empty (no spans, the
hash of the empty string); repeated rows are searched one by one; redact() keeps all columns, find() passes over extra
ones. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a number that fails from its first digit fails from the others too
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@+]")
#: Tokens end at white space and at the separators of lists.
TOKEN = re.compile(r"[^\s,;|]+")
BETWEEN = re.compile(r"[\s,;|]+")
SEPARATOR = re.compile(r"[,;|]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


@dataclass(frozen=True)
class PiiParams:
    """mask: what redact() writes for a span of the kind."""

    mask: str = "[{}]"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns as (start, end, kind), by start and then in the order of KINDS."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        done = m.end() if m else done
        if m:
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> str:
    """The token with letters as a, digits as 9, runs of either cut to one, other signs as they are."""
    return re.sub(r"9+", "9", re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token))))


N_OWN = 23


@lru_cache(maxsize=65536)
def _own(token: str) -> tuple[float, ...]:
    """Word-shape features of one token."""
    s, n = shape(token.strip(".,;:!?\"'")), len(NOT_DIGIT.sub("", token))
    core = s.strip("()[]<>")
    parts = core.split("9")
    return (
        1.0, float("@" in s), float(bool(re.search(r"@[a9.-]*\.a", s))), float(s.startswith("+9")), float(s.startswith("(")),
        float(core == "9"), float(core == "9.9.9.9"), float(bool(re.fullmatch(r"9(-9)+", core))), float(bool(re.fullmatch(r"9(\.9)+", core))),
        float("a" in s), float("=" in s), float(":" in s), float("/" in s), float("%" in s or "$" in s or "€" in s),
        float(n == 0), float(1 <= n <= 2), float(n == 3), float(n == 4), float(5 <= n <= 9), float(10 <= n <= 11), float(n >= 12), float(len(parts) == 4), float(len(parts) == 5),
    )


def features(tokens: list[str], before: str = "", after: str = "") -> np.ndarray:
    """One row for each token: its own shape features, and those of the token before and after it (zeros: none)."""
    own = np.array([_own(t) for t in tokens]).reshape(len(tokens), N_OWN)
    side = lambda t: np.array([_own(t)]) if t else np.zeros((1, N_OWN))
    return np.hstack([own, np.vstack([side(before), own[:-1]]), np.vstack([own[1:], side(after)])])


@dataclass
class Crf:
    """w: features x labels; t: label x next label."""

    w: np.ndarray
    t: np.ndarray

    def scores(self, tokens: list[str], before: str = "", after: str = "", chunk: int = 4096) -> np.ndarray:
        """Label scores of each token, by chunks of tokens between their true neighbours."""
        at = range(0, len(tokens), chunk)
        sides = [(tokens[lo - 1] if lo else before, tokens[lo + chunk] if lo + chunk < len(tokens) else after) for lo in at]
        return np.vstack([features(tokens[lo : lo + chunk], *side) @ self.w for lo, side in zip(at, sides, strict=True)])

    def viterbi(self, runs: list[np.ndarray], cells: int = 1 << 16) -> list[np.ndarray]:
        """Best labels of each run of label scores; runs of like length go step by step together, as many as fill cells."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(runs[order[hi]]) <= cells:
                hi += 1
            part, lo = order[lo:hi], hi
            size = np.array([len(runs[k]) for k in part])
            e = np.zeros((len(part), size.max(), len(LABELS)))
            for j, k in enumerate(part):
                e[j, : size[j]] = runs[k]
            score = e[:, 0] + self.t[0]  # a run follows an O
            back = np.zeros(e.shape, np.int8)
            for i in range(1, e.shape[1]):
                step = score[:, :, None] + self.t
                back[:, i] = step.argmax(axis=1)
                score = np.where((i < size)[:, None], step.max(axis=1) + e[:, i], score)
            label = (score + self.t[:, 0]).argmax(axis=1)  # and an O follows it
            path = np.zeros(e.shape[:2], np.int8)
            for i in range(e.shape[1] - 1, -1, -1):
                path[:, i] = np.where(i < size, label, 0)
                label = np.where((i < size) & (i > 0), back[np.arange(len(part)), i, label], label)
            for j, k in enumerate(part):
                out[k] = path[j, : size[j]]
        return out


def train(rows: list[tuple[list[str], list[int]]], steps: int = 200, rate: float = 0.15, l2: float = 0.002) -> Crf:
    """Penalised maximum likelihood by Adam steps, with forward and backward sums over all sentences at once."""
    size = np.array([len(t) for t, _ in rows])
    n, most, k = len(rows), int(size.max()), len(LABELS)
    x, y = np.zeros((n, most, 3 * N_OWN)), np.zeros((n, most), int)
    for j, (tokens, labels) in enumerate(rows):
        x[j, : size[j]], y[j, : size[j]] = features(tokens), labels
    here = np.arange(most)[None] < size[:, None]
    pair = here[:, 1:]
    one = np.eye(k)[y] * here[:, :, None]
    seen_w, seen_t = np.einsum("nif,nik->fk", x, one), np.einsum("nia,nib->ab", one[:, :-1], one[:, 1:])
    theta = np.zeros(3 * N_OWN * k + k * k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    add = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    for step in range(1, steps + 1):
        w, t = theta[: 3 * N_OWN * k].reshape(-1, k), theta[3 * N_OWN * k :].reshape(k, k)
        e = x @ w
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, most):
            alpha[:, i] = np.where(here[:, i, None], add(alpha[:, i - 1, :, None] + t, 1) + e[:, i], alpha[:, i - 1])
        for i in range(most - 2, -1, -1):
            beta[:, i] = np.where(here[:, i + 1, None], add(t + (e[:, i + 1] + beta[:, i + 1])[:, None], 2), 0)
        z = add(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * here[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None] - z[:, None, None, None]) * pair[:, :, None, None]
        g = np.concatenate([(seen_w - np.einsum("nif,nik->fk", x, node)).ravel(), (seen_t - edge.sum(axis=(0, 1))).ravel()]) / n - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[: 3 * N_OWN * k].reshape(-1, k), theta[3 * N_OWN * k :].reshape(k, k))


def labelled_tokens(n: int = 400, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """A small labelled table made by rule: sentences as tokens with the index of each token's label in LABELS."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    byte = lambda: str(rng.integers(1, 256))
    hexa = lambda k: "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, k))
    made = (
        (1, lambda: [f"{word()}.{d(2)}@{word()}.example.com"]), (1, lambda: [f"<{word()}@{word()}.org>"]), (1, lambda: [f"{word()}_{word()}@{word()}.co.uk"]),
        (2, lambda: [".".join(byte() for _ in range(4))]), (2, lambda: [f"({'.'.join(byte() for _ in range(4))})"]),
        (3, lambda: [d(16)]), (3, lambda: [d(4) for _ in range(4)]), (3, lambda: ["-".join(d(4) for _ in range(4))]), (3, lambda: [d(4), d(6), d(5)]),
        (4, lambda: ["+1", f"({d(3)})", f"{d(3)}-{d(4)}"]), (4, lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"]), (4, lambda: [f"{d(3)}-{d(3)}-{d(4)}"]), (4, lambda: [f"+{d(2)}", d(3), d(4), d(3)]), (4, lambda: [f"{d(3)}.{d(3)}.{d(4)}"]),
        (0, lambda: [d(4)]), (0, lambda: [d(1)]), (0, lambda: [d(2), d(3)]), (0, lambda: [f"{d(1)}.{d(1)}"]), (0, lambda: [f"v{d(1)}.{d(1)}.{d(2)}"]), (0, lambda: [f"${d(3)}.{d(2)}"]), (0, lambda: [f"{d(2)}%"]),
        (0, lambda: [f"20{d(2)}-{d(2)}-{d(2)}"]), (0, lambda: [f"{d(2)}/{d(2)}/20{d(2)}"]), (0, lambda: [f"{d(2)}:{d(2)}"]), (0, lambda: [f"password={hexa(20)}"]), (0, lambda: ["token", "=", f'"{hexa(40)}"']), (0, lambda: [hexa(12)]), (0, lambda: [f"#{d(3)}"]), (0, lambda: [f"@{word()}"]), (0, lambda: [d(8)]), (0, lambda: [f"{word()}{d(2)}"]), (0, lambda: [f"+{d(2)}"]), (0, lambda: [d(1), d(1), d(2), d(1)]), (0, lambda: ["1+1", "2"]),
    )
    rows = []
    for k in range(n):
        tokens, labels = [], []
        for _ in range(1 + k % 3):
            label, make = made[rng.integers(len(made))]
            for _ in range(rng.integers(1, 4)):
                tokens.append(word() + (".," * 1)[: rng.integers(0, 2)])
                labels.append(0)
            got = make()
            if rng.integers(0, 4) == 0:
                got[-1] += ".,;"[rng.integers(0, 3)]
            tokens += got
            labels += [label] * len(got)
        rows.append(([*tokens, word()], [*labels, 0]))
    return rows


@cache
def default_model() -> Crf:
    """The field trained from labelled_tokens()."""
    return train(labelled_tokens())


def _plausible(kind: str, piece: str) -> bool:
    n = len(NOT_DIGIT.sub("", piece))
    return {"email": "@" in piece and "." in piece, "ip": piece.count(".") == 3 and 4 <= n <= 12, "card": 12 <= n <= 19, "phone": 7 <= n <= 15}[kind]


@dataclass
class Run:
    """Tokens side by side that may be personal data, and the tokens before and after them."""

    spans: list[tuple[int, int]]
    before: str
    after: str


def _ends(c: str) -> bool:
    return c.isspace() or c in ",;|"


def _token_before(text: str, at: int) -> str:
    """The token that ends before at."""
    end = at
    while end > 0 and _ends(text[end - 1]):
        end -= 1
    start = end
    while start > 0 and not _ends(text[start - 1]):
        start -= 1
    return text[start:end]


def runs_of(text: str) -> list[Run]:
    """The runs of a text. Only the tokens around each trigger sign, and their neighbours, are looked at."""
    runs: list[Run] = []
    at, edge = 0, -1
    while m := TRIGGER.search(text, at):
        start = m.start()
        while start > at and not _ends(text[start - 1]):
            start -= 1
        at = TOKEN.match(text, start).end()
        if edge >= 0 and BETWEEN.fullmatch(text, edge, start):
            runs[-1].spans.append((start, at))
        else:
            runs.append(Run([(start, at)], _token_before(text, start), ""))
        runs[-1].after = ""
        edge = at
        if not (n := TOKEN.search(text, at)) or not TRIGGER.search(n[0]):
            runs[-1].after = n[0] if n else ""
    return runs


class _Free:
    """What spans (by start) leave free: the stretches that they cover are joined and searched by halving."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for a, b, _ in spans:
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def has(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)  # the last stretch that starts before b
        return i == 0 or self.ends[i - 1] <= a


def find_batch(texts: list[str], crf: Crf, p: PiiParams) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans."""
    base = [base_spans(t) for t in texts]
    where, scores = [], []
    for k, text in enumerate(texts):
        for run in runs_of(text):
            where.append((k, run.spans))
            scores.append(crf.scores([text[a:b] for a, b in run.spans], run.before, run.after))
    added: list[list[Span]] = [[] for _ in texts]
    free = [_Free(b) for b in base]
    for (k, run), labels in zip(where, crf.viterbi(scores), strict=True):
        j = 0
        while j < len(run):
            e = j
            while e + 1 < len(run) and labels[e + 1] == labels[j] and not SEPARATOR.search(texts[k], run[e][1], run[e + 1][0]):
                e += 1
            if labels[j]:
                piece = texts[k][run[j][0] : run[e][1]]
                cut = len(piece) - len(piece.lstrip("<[{\"'.,;:"))
                a, b = run[j][0] + cut, run[j][0] + len(piece.rstrip(">]}\"'.,;:!?"))
                if a < b and _plausible(LABELS[labels[j]], texts[k][a:b]) and free[k].has(a, b):
                    added[k].append((a, b, LABELS[labels[j]]))
            j = e + 1
    return [(b, sorted([*b, *x], key=lambda s: (s[0], KINDS.index(s[2])))) for b, x in zip(base, added, strict=True)]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, crf: Crf | None = None, p: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans, one row for each row of docs."""

    crf = crf or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                found = find_batch([t or "" for t in part.column("text").to_pylist()], crf, p)
                counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
                digests = pa.array([hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found], pa.string())
                columns = [part.column("doc_id"), *counts, digests, pa.array([_told(s) for _, s in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked(text: str, spans: list[Span], mask: str) -> str:
    """text with each span replaced by its kind's mask; overlapping spans are one replacement, named by the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], mask.format(kind.upper())]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, crf: Crf | None = None, p: PiiParams = PiiParams()) -> DataFrame:
    """docs with all spans of text masked (a null text stays null) and n_chars, where present, as the new length."""
    crf = crf or default_model()

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(texts), 64):
            part = [t if isinstance(t, str) else "" for t in texts.iloc[lo : lo + 64]]
            out += [masked(t, s, p.mask) for t, (_, s) in zip(part, find_batch(part, crf, p), strict=True)]
        return pd.Series(out, dtype=object)

    done = docs.withColumn("text", F.when(F.col("text").isNotNull(), mask("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
