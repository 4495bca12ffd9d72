"""Personal data by patterns and a skip-chain conditional random field (operator 9).

The base patterns find e-mail addresses, IP addresses, card and phone numbers.  A conditional
random field over the tokens that hold a digit or an @ then looks for the same entities in
forms the patterns miss (a phone number without its +, a cut address).  It runs on every document
with such a token that no base span covers.  Neighbouring tokens are chained; tokens that repeat or
resemble each other anywhere in the document are joined by skip edges, along which loopy belief
propagation carries the labels that the base patterns fix.  The weights are trained by
pseudo-likelihood on a bounded sample of texts, into which damaged forms are put: repeats of the
text's own entities and full phone numbers as positives, look-alikes that nothing supports as
negatives.  Patterns, tokens and edges are found in time linear in the text.
"""

from __future__ import annotations

import bisect
import dataclasses
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can only begin where a run of digits does, so no run is read more than a few times.
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")
_SEED = re.compile(r"[0-9@]\S*")
_NOT_DIGIT = re.compile("[^0-9]")
_GROUPS = re.compile("[0-9]+")
_EDGE = "\"'“”«»()[]{}<>,;:!?.*_|&%$#"

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right: the run of address characters before each @, and the host behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        done = at + 1
        if host:
            done = host.end()
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """What the patterns find: by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in _PATTERNS.items():
            if kind != "phone" or "+" in text:
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


@dataclasses.dataclass
class Graph:
    """Tokens of one document with a digit or an @: where they are, their features, labels and edges."""

    places: list[tuple[int, int]]
    features: list[list[int]]
    labels: list[int]  # 0: none; k + 1: a base span of KINDS[k]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


FEATURES = 28
_PHONE_LIKE = re.compile(r"\(?\d{3}\)?[-. ]?\d{3}[-. ]\d{4}\Z|\d{3}[-.]\d{4}\Z")


def _features(token: str, digits: str) -> list[int]:
    n = len(digits)
    letters = any(map(str.isalpha, token))
    on = [0]
    on.append(1 if "@" in token else 2)
    on.append(3 + (n > 0) + (n > 3) + (n > 6) + (n > 8) + (n > 12) + (n > 19))
    on.append(10 if letters else 11)
    dots = token.count(".")
    on.append(12 if dots == 3 else 13 if dots else 14)
    if "-" in token or "/" in token:
        on.append(15)
    if "=" in token or '"' in token:
        on.append(16)
    if token[0] == "+":
        on.append(17)
    if len(token) > 24:
        on.append(18)
    if letters and n > 3:
        on.append(19)
    if not letters and _PHONE_LIKE.match(token):
        on.append(20)
    if token[0] == "(":
        on.append(21)
    if n == len(token):
        on.append(22)
    groups = [*map(len, _GROUPS.findall(token))] if len(token) <= 40 else []
    if len(groups) == 4 and max(groups) <= 3:
        on.append(23)
    if len(groups) >= 4 and set(groups) == {4}:
        on.append(24)
    if "," in token:
        on.append(25)
    if n == 10 or n == 11:
        on.append(26)
    if n == 3 and len(token) <= 5:
        on.append(27)
    return on


def _keys(token: str, digits: str) -> list[str]:
    """Tokens that share a key resemble each other: the token, its digits, their end, its groups of digits, an address's local part."""
    keys = ["t" + token.lower()]
    if len(digits) >= 7:
        keys += ["d" + digits, "e" + digits[-7:]]
    if len(token) <= 40 and len(groups := _GROUPS.findall(token)) > 2:
        keys.append("g" + " ".join(groups))
    local, at, host = token.partition("@")
    if len(local) >= 4 and (at or any(map(str.isalpha, local))):
        keys.append("l" + local.lower())
    return keys


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Where the stretches without white space are that hold a digit or an @."""
    done = 0
    for m in _SEED.finditer(text):
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = m.end()
        yield start, done


def graph_of(text: str, base: list[Span]) -> Graph:
    g = Graph([], [], [], [], [])
    covered = sorted((a, b, KINDS.index(kind) + 1) for kind, a, b in base)
    last: dict[str, int] = {}
    k = 0
    for at, stop in _tokens(text):
        raw = text[at:stop]
        token = raw.strip(_EDGE)
        if not token:
            continue
        start = at + len(raw) - len(raw.lstrip(_EDGE))
        end = start + len(token)
        if start > at and text[start - 1] == "(" and (")" in token or text[end : end + 1] == ")"):  # (201) 555-0123
            start, end = start - 1, end + (")" not in token)
            token = text[start:end]
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        i = len(g.places)
        inside = k < len(covered) and covered[k][0] < end
        digits = _NOT_DIGIT.sub("", token)
        if i and start - g.places[-1][1] <= 3:
            g.chain.append((i - 1, i))
        g.places.append((start, end))
        g.features.append(_features(token, digits))
        g.labels.append(covered[k][2] if inside else 0)
        linked = set()
        # One- or two-digit tokens repeat by chance.
        for key in _keys(token, digits) if len(digits) >= 3 or "@" in token else ():
            if key in last and last[key] not in linked:
                g.skip.append((last[key], i))
                linked.add(last[key])
            last[key] = i
    return g


@dataclasses.dataclass
class Weights:
    node: np.ndarray  # FEATURES x labels
    chain: float
    skip: float


LABELS = len(KINDS) + 1


def marginals(g: Graph, w: Weights, rounds: int = 12) -> np.ndarray:
    """Loopy belief propagation: the probability of each label of each token; base labels are observed."""
    n = len(g.places)
    unary = np.array([w.node[f].sum(axis=0) for f in g.features]).reshape(n, LABELS)
    for i, y in enumerate(g.labels):
        if y:
            unary[i] = -50.0
            unary[i, y] = 0.0
    edges = np.array([*g.chain, *g.skip], np.int64).reshape(-1, 2)
    if len(edges):
        gain = np.exp(np.r_[np.full(len(g.chain), w.chain), np.full(len(g.skip), w.skip)])
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        gain, m = np.r_[gain, gain][:, None], len(edges)
        back = np.r_[np.arange(m, 2 * m), np.arange(m)]
        sent = np.zeros((2 * m, LABELS))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, sent)
            out = belief[src] - sent[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(out.sum(axis=1, keepdims=True) + (gain - 1) * out)
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - sent).max() < 1e-4:
                sent = new
                break
            sent = 0.5 * sent + 0.5 * new
        np.add.at(unary, dst, sent)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the field adds runs of tokens of one label that no base span touches."""
    base = base_spans(text)
    g = graph_of(text, base)
    if all(g.labels):
        return base, base
    best = marginals(g, w).argmax(axis=1)
    added: list[Span] = []
    joined = {b for _, b in g.chain}
    starts, ends = _cover(base)
    run = -2
    for i in np.flatnonzero(best).tolist():
        start, end = g.places[i]
        k = bisect.bisect_right(ends, start)
        if g.labels[i] or (k < len(starts) and starts[k] < end):
            continue
        kind = KINDS[best[i] - 1]
        if run == i - 1 and i in joined and added and added[-1][0] == kind:
            added[-1] = (kind, added[-1][1], end)
        else:
            added.append((kind, start, end))
        run = i
    # A lone short number says nothing; one of a few digits counts only within a run.
    added = [s for s in added if s[0] == "email" or len(_NOT_DIGIT.sub("", text[s[1] : s[2]])) >= 4]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _cover(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _damaged(kind: str, found: str, rng: random.Random) -> str:
    """A form of a found entity that the patterns miss."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        local, _, host = found.partition("@")
        return rng.choice([f"{local}@{host.split('.')[0]}", f"{local}@", f"{local}@{host.replace('.', ',')}"])
    if kind == "ip":
        return found.replace(".", rng.choice("-,_/"))
    if kind == "card":
        return rng.choice("./_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return rng.choice([digits, digits[-10:], f"00{digits}", _national(digits, rng)])


def _national(digits: str, rng: random.Random) -> str:
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])


def _harmless(rng: random.Random) -> str:
    """Dates, times, amounts, versions and the like."""
    year, month, day, big = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(1000, 10**7)
    return rng.choice([f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month:02d}/{day:02d}/{year}", f"{day}:{month:02d}:{day:02d}", f"{big:,}", f"{big:,}.{day:02d}", f"{month}.{day}.{month}", f"{year}-{year + 1}", f"#{big}"])


def train(texts: list[str], seed: int = 11, epochs: int = 600, rate: float = 1.0) -> Weights:
    """Pseudo-likelihood: each unobserved token's label given those of its neighbours.

    Damaged forms are put between the words of the texts.  Repeats of the text's own entities and national
    phone numbers are entities; other damaged forms, and the texts' own uncovered tokens, are none.
    """
    rng = random.Random(seed)
    found = [(kind, text[a:b]) for text in texts for kind, a, b in base_spans(text)]
    # Entities of each kind even where the sample has few.
    found += [("email", f"user{k}.{k}@host{k}.example.com") for k in range(20)] + [("ip", f"10.{k}.{2 * k}.7") for k in range(20)]
    found += [("card", "4111111111111111"), ("card", "5500005555555559")] * 10 + [("phone", f"+1 (201) 555-01{k:02d}") for k in range(20)]
    xs, chains, skips, ys = [], [], [], []

    def add(text: str, hidden: list[tuple[str, str]], decoys: list[str]) -> None:
        places = [m.start() for m in re.finditer(r"(?<![\s0-9@])\s(?=[^\W\d_])", text)] or [len(text)]
        put = sorted(((rng.choice(places), kind, value) for kind, value in [*hidden, *(("", d) for d in decoys)]), key=lambda x: x[0])
        parts: list[str] = []
        truth: list[tuple[int, int, int]] = []
        done = size = 0
        for at, kind, value in put:
            tail = f" {rng.randrange(256)}.0.113.{rng.randrange(256)}" if kind == "phone" and value[0] == "+" else " at"
            parts += [text[done:at], " and ", value, tail]
            size += at - done + 5
            if kind:
                truth.append((size, size + len(value), KINDS.index(kind) + 1))
            size += len(value) + len(tail)
            done = at
        text = "".join([*parts, text[done:]])
        g = graph_of(text, base_spans(text))
        y = [label or next((k for a, b, k in truth if a < end and start < b), 0) for label, (start, end) in zip(g.labels, g.places, strict=True)]
        chain, skip = np.zeros((len(y), LABELS)), np.zeros((len(y), LABELS))
        for table, edges in ((chain, g.chain), (skip, g.skip)):
            for a, b in edges:
                table[a, y[b]] += 1
                table[b, y[a]] += 1
        for i, (label, seen) in enumerate(zip(y, g.labels, strict=True)):
            if not seen:
                row = np.zeros(FEATURES)
                row[g.features[i]] = 1
                xs.append(row)
                chains.append(chain[i])
                skips.append(skip[i])
                ys.append(label)

    for text in [*texts, *("" for _ in range(60))]:
        base = [(kind, text[a:b]) for kind, a, b in base_spans(text)]
        extra = rng.sample(found, 1)
        if not base:
            text, base = f"{text} word {extra[0][1]} word", extra
        hidden = [(kind, _damaged(kind, value, rng)) for kind, value in base if rng.random() < 0.7][:4]
        if rng.random() < 0.3:
            hidden.append(("phone", _national(f"{rng.randrange(2 * 10**9, 10**10)}", rng)))
        if rng.random() < 0.3:  # digits right behind a number hide it from the pattern
            hidden.append(("phone", f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"))
        others = [(kind, value) for kind, value in rng.sample(found, 2) if (kind, value) not in base]
        decoys = [_damaged(kind, value, rng) for kind, value in others if kind != "phone"]
        decoys += [str(rng.randrange(10 ** rng.randrange(3, 17))), _harmless(rng)]
        add(text, hidden, decoys)
    x, chain, skip, y = np.array(xs), np.array(chains), np.array(skips), np.array(ys)
    w = Weights(np.zeros((FEATURES, LABELS)), 0.0, 0.0)
    for _ in range(epochs):
        score = x @ w.node + w.chain * chain + w.skip * skip
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w.node -= rate * (x.T @ p / len(y) + 1e-4 * w.node)
        w.chain -= rate * float((p * chain).sum() / len(y))
        w.skip -= rate * float((p * skip).sum() / len(y))
    w.chain, w.skip = max(0.0, w.chain), max(0.0, w.skip)
    return w


def fit_weights(docs: DataFrame, rows: int = 800, most_chars: int = 20_000) -> Weights:
    """Train on at most ``rows`` texts with a digit or an @, of at most ``most_chars`` characters each, drawn by
    their hashes: those two bounds are all that reaches the driver."""
    fit = docs.where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= most_chars))
    n = fit.count()
    drawn = fit.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, 3 * rows / max(1, n))))
    texts = [r["text"] for r in drawn.select("text").orderBy(F.xxhash64("text"), "text").limit(rows).collect()]
    return train(texts)


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, a digest of them, and all spans, for each row of ``docs``.

    A null or empty text has none.  A null ``doc_id`` stays null, rows that repeat give as many equal rows,
    and other columns of ``docs`` are left out.  Without any text to learn from the weights come from made-up
    entities alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_weights(rows))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]

    def one(text: str) -> tuple:
        base, spans = all_spans(text, shared.value)
        return (*(sum(s[0] == kind for s in base) for kind in KINDS), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans), len(spans) - len(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of each text replaced; a null text stays null, other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_weights(docs.select(F.col("text").cast("string").alias("text"))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redacted(t, all_spans(t, shared.value)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
