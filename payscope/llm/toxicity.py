"""Toxicity by Levenshtein automata over a lexicon trie, with context windows (operator 8).

The lexicon is learned from labelled texts: words, and stems of several words, that are far more
frequent in toxic ones.  Near copies among them are found by their word shingles and share one vote, and a
term must hold in both halves of the texts.  Every token runs through the automaton that accepts
whatever lies within one edit of a term, intersected with the trie of the terms and made deterministic
as it is used.  A hit counts as quotation or as abuse by the window of words around it, and a
logistic model over the weighted hits of both sorts gives the score.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 8
#: Terms of fewer letters must match exactly.
SHORTEST_FUZZY = 5
#: Letters of a stem.
STEMS = (4, 5, 6, 7, 8)
_EDGE = "\"'“”„«»‘’()[]{}<>,;:.?!…*_-|"
_OPEN, _CLOSE = "\"“„«‘'(", "\"”“»’')"
#: Digits and signs that stand for letters inside a word.
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_CACHE = 400_000


def normal(token: str) -> str:
    """Lower case, without marks at its edges; look-alike digits and signs as letters if letters are beside them."""
    token = token.strip(_EDGE).lower()
    if token and not token.isalpha() and any(map(str.isalpha, token)):
        token = token.translate(_LOOKALIKE)
    return token


@dataclasses.dataclass
class Term:
    text: str
    weight: float
    stem: bool = False
    fuzzy: bool = True


class Automaton:
    """The trie of the terms intersected with the Levenshtein automata of distance one.

    A state is a set of (trie node, edits so far); states and steps are made when first met.
    """

    def __init__(self, terms: list[Term]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for k, term in enumerate(terms):
            node = 0
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][c]
            self.ends[node] = k
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, members: set[tuple[int, int]]) -> int:
        # Leaving out a letter of the term is an edit without input.
        members = members | {(child, 1) for node, edits in members if not edits for child in self.children[node].values()}
        key = frozenset(m for m in members if not (m[1] and (m[0], 0) in members))
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.members[state]:
            children = self.children[node]
            if c in children:
                out.add((children[c], edits))
            if not edits:
                out.add((node, 1))
                out.update((child, 1) for child in children.values())
        nxt = self._state(out) if out else -1
        self.steps[state][c] = nxt
        return nxt

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the best term for the whole token (of a stem: for its beginning), or None.

        Fewer edits go first, then the greater weight.
        """
        state, best = self.start, None
        for i, c in enumerate(token, 1):
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                break
            for node, edits in self.members[state]:
                k = self.ends[node]
                if k < 0 or not (self.terms[k].stem or i == len(token)) or (edits and not (self.terms[k].fuzzy and len(self.terms[k].text) >= SHORTEST_FUZZY)):
                    continue
                if best is None or (edits, -self.terms[k].weight, k) < (best[1], -self.terms[best[0]].weight, best[0]):
                    best = (k, edits)
        return best


class _Hits(dict):
    """Raw token -> (weight, edits) or None; emptied when it has grown to its bound."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, raw: str) -> tuple[float, int] | None:
        if len(self) >= _CACHE:
            self.clear()
        token = normal(raw)
        m = self.automaton.match(token) if token else None
        self[raw] = out = (self.automaton.terms[m[0]].weight, m[1]) if m else None
        return out


def _quoted(tokens: list[str], i: int) -> bool:
    """An opening mark in the window before the token, not closed before it, and a closing one after."""
    opened = False
    for t in tokens[max(0, i - CONTEXT) : i]:
        opened = (opened or t[0] in _OPEN) and not (t[-1] in _CLOSE or t.rstrip(".,;:!?")[-1:] in tuple(_CLOSE))
    return (opened or tokens[i][0] in _OPEN) and any(t.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for t in tokens[i : i + CONTEXT + 1])


FEATURES = 5


def features(text: str | None, hits: _Hits) -> tuple[list[float], int, int]:
    """The model's inputs, the hits and those in quotation, over the whole text."""
    tokens = (text or "").split()
    found = [(i, h) for i, h in enumerate(map(hits.__getitem__, tokens)) if h]
    exact = fuzzy = quoted = 0.0
    n_quoted = 0
    for i, (weight, edits) in found:
        if _quoted(tokens, i):
            quoted += weight
            n_quoted += 1
        else:
            # A near miss says nearly as much; ``fuzzy`` lets the model correct that.
            exact += 0.8 * weight if edits else weight
            fuzzy += weight if edits else 0.0
    places = [i for i, _ in found]
    dense = max((sum(1 for q in places[k : k + CONTEXT] if q - p <= CONTEXT) for k, p in enumerate(places)), default=0)
    return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(dense)], len(found), n_quoted


@dataclasses.dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray


def family_of(texts: list[str], width: int = 5, likeness: float = 0.5) -> list[int]:
    """The family of each text: texts that share at least ``likeness`` of their shingles of ``width`` words, directly
    or through others.  Texts of fewer words are compared as a whole."""
    cut = lambda w: np.unique(np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + width])) for k in range(max(1, len(w) - width + 1))], np.uint64))
    shingles = [cut(text.lower().split()) for text in texts]
    holders: dict[int, tuple[int, ...]] = {}
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, own in enumerate(shingles):
        # Of a family only the first is kept as a holder, so no shingle has more holders than families.
        keys = own.tolist()
        shared = Counter(j for s in keys for j in holders.get(s, ()))
        for j, n in shared.items():
            if n >= likeness * min(len(own), len(shingles[j])):
                root[find(i)] = find(j)
        if find(i) == i:
            for s in keys:
                holders[s] = (*holders.get(s, ()), i)
    return [find(i) for i in range(len(texts))]


def learn_terms(texts: list[str], toxic: list[int], families: list[int], least: int = 3) -> list[Term]:
    """Words and stems whose document frequency is far higher among the toxic texts.

    A family of near copies has one vote of each label.  A term needs the votes of ``least`` toxic families,
    and high odds among the families of either half.  Words are of 3 to 40 letters; a stem of 4 to 8 letters
    stands for at least five of them.
    """
    size = Counter(zip(families, toxic, strict=True))
    # Halves by family, dealt in turn within each label.
    half = {f: k % 2 for y in (0, 1) for k, f in enumerate(sorted({f for f, own in zip(families, toxic, strict=True) if own == y}))}
    total = [[0.0, 0.0], [0.0, 0.0]]
    votes: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
    stems: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)
    members: dict[str, set[str]] = defaultdict(set)
    for text, y, f in zip(texts, toxic, families, strict=True):
        vote, h = 1 / size[f, y], half[f]
        total[h][y] += vote
        own = {w for w in map(normal, set(text.split())) if 3 <= len(w) <= 40 and w.isalpha()}
        for w in own:
            votes[w][2 * h + y] += vote
        for stem in {w[:k] for w in own for k in STEMS if len(w) > k}:
            stems[stem][2 * h + y] += vote
        if y:
            for w in own:
                for k in STEMS:
                    if len(w) > k:
                        members[w[:k]].add(w)

    def odds(v: list[float], halves: tuple[int, ...] = (0, 1)) -> float:
        share = lambda y: (sum(v[2 * h + y] for h in halves) + 0.5) / (sum(total[h][y] for h in halves) + 1)
        return math.log(share(1)) - math.log(share(0))

    toxic_families = total[0][1] + total[1][1]
    holds = lambda v, most: v[1] + v[3] >= max(least, 0.012 * toxic_families) and odds(v) >= math.log(most) and min(odds(v, (0,)), odds(v, (1,))) >= math.log(most) / 2
    chosen: dict[str, Term] = {}
    spread = [s for s, v in stems.items() if holds(v, 12) and len(members[s]) >= 5]
    # The stem with the best odds stands for those that begin like it.
    for stem in sorted(spread, key=lambda s: (-odds(stems[s]), len(s), s)):
        if not any(stem.startswith(t) or t.startswith(stem) for t in chosen):
            chosen[stem] = Term(stem, odds(stems[stem]), stem=True)
    # Words that a stem stands for are terms too: their misspellings may lie within the stem.
    for word, v in votes.items():
        if word not in chosen and holds(v, 12):
            chosen[word] = Term(word, odds(v))
    return sorted(chosen.values(), key=lambda t: (-t.weight, t.text))


def train(texts: list[str], toxic: list[int], prevalence: float) -> Model:
    """Lexicon, then logistic weights by Newton steps; ``prevalence``: the share of toxic rows the sample stands for."""
    families = family_of(texts)
    terms = learn_terms(texts, toxic, families)
    automaton = Automaton(terms)
    # A term whose near forms occur in clean texts is matched exactly.
    near: Counter[int] = Counter()
    for word, n in Counter(w for text, y in zip(texts, toxic, strict=True) if not y for w in set(map(normal, text.split()))).items():
        m = automaton.match(word)
        if m and m[1]:
            near[m[0]] += n
    clean = max(1, len(toxic) - sum(toxic))
    terms = [dataclasses.replace(t, fuzzy=near[k] <= 0.001 * clean) for k, t in enumerate(terms)]
    hits = _Hits(Automaton(terms))
    x = np.array([features(t, hits)[0] for t in texts]).reshape(-1, FEATURES)
    y = np.array(toxic, float)
    w = np.zeros(FEATURES)
    # A hit in quotation says nothing unless the texts show otherwise, nor does a near miss say more than a plain hit.
    ridge = np.diag([1e-3, 0.05, 0.5, 0.5, 0.2])
    prior = np.array([0.0, 1.0, 0.0, 0.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ (w - prior)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prevalence = min(max(prevalence, 1e-3), 1 - 1e-3)
    w[0] += math.log(prevalence / (1 - prevalence)) - math.log(share / (1 - share))
    return Model(terms, w)


def fit_model(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2000, most_chars: int = 50_000) -> Model:
    """Train on at most about ``rows_per_class`` labelled texts of each class, of at most ``most_chars`` characters each,
    chosen by a hash of the id.

    ``labels``: (doc_id, toxic); rows without a label are left out.  Only the ids drawn are
    broadcast, whose number the bound limits.
    """
    known = labels.where("toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model([], np.array([-20.0 if counts.get(0) or not counts else 20.0, 0, 0, 0, 0]))
    share = F.when(F.col("toxic") == 1, F.lit(rows_per_class / counts[1])).otherwise(F.lit(rows_per_class / counts[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).orderBy(F.xxhash64("doc_id"), "toxic").limit(3 * rows_per_class)
    texts = docs.where(F.col("text").isNull() | (F.char_length("text") <= most_chars))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("text", "toxic").orderBy(F.xxhash64("text"), "text", "toxic").limit(3 * rows_per_class).collect()
    return train([r["text"] or "" for r in rows], [r["toxic"] for r in rows], counts[1] / (counts[0] + counts[1]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, hits, quoted_hits) for each row of ``docs``; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, w = _Hits(Automaton(shared.value.terms)), shared.value.weights
        for batch in batches:
            rows = [features(t.as_py(), hits) for t in batch.column(1)]
            x = np.array([r[0] for r in rows]).reshape(-1, FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.record_batch(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["doc_id", "score", "predicted", "hits", "quoted_hits"],
            )

    return docs.mapInArrow(run, "doc_id long, score double, predicted int, hits long, quoted_hits long")


def score_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2000) -> DataFrame:
    """(doc_id, score, predicted, hits, quoted_hits) of all ``docs`` by a model of ``labels`` (doc_id, toxic).

    One row for each row of ``docs``: rows that repeat get equal scores, a null ``doc_id`` stays null, and other columns
    are left out.  A null or empty text scores as one without hits.  Labels of one class only, or none, give
    that class (0 for none) to every text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(rows, fit_model(rows, labels, rows_per_class))
