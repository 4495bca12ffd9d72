"""Language identification (operator 6): averaged hashed subword embeddings under a linear softmax.

A text is the mean embedding of its hashed 3- and 4-byte subwords (words end at white space); a
linear softmax over that mean gives the language.  Both are trained by stochastic gradient descent
in numpy on a bounded sample.  A temperature fitted on held-back sample rows calibrates the
probabilities.

Rejection is calibrated too.  Four models (or one for each language, if those are fewer) are trained, each without a share of the languages; what
they make of the languages left out, and of texts whose letters are shuffled, are the wrong examples, and what they make of
held-back texts of their own languages the right ones.  A logistic regression on the log odds of the
best language and the share of subwords that its training texts hold tells them apart, and the threshold is
the one that rejects ``reject_share`` of the right ones.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
TABLE_BITS = 15
DIM = 12
#: A small sample is passed over until so many steps are taken, else it is hardly learned.
LEAST_STEPS = 400
#: The models that calibrate the rejection take so many steps at most, but pass over their rows twice at least.
MOST_STEPS = 6000
#: Models that are trained without some of the languages, each without another share of them.
FOLDS = 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of text that are coded at a time.
_BLOCK = 1 << 20


def subword_codes(text: str) -> Iterator[np.ndarray]:
    """Hash codes of the 3- and 4-byte subwords of the whole text, a bounded block at a time.

    Anything in ASCII but letters separates words; a separator is part of the subwords at a word's edge.
    """
    raw = b" " + _SPACE.sub(b" ", text.encode("utf-8", "replace").translate(_LOWER)).strip() + b" "
    for at in range(0, len(raw), _BLOCK):
        b = np.frombuffer(raw[at : at + _BLOCK + 3], np.uint8).astype(np.uint32)
        if len(b) < 3:
            return
        three = b[:-2] + (b[1:-1] << 8) + (b[2:] << 16)
        codes = (three * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
        inside = b[1:-1] != 32
        yield codes[inside]
        if len(b) > 3:
            four = three[:-1] ^ (b[3:] << np.uint32(24))
            codes = (four * np.uint32(2246822519) + np.uint32(374761393)) >> np.uint32(32 - TABLE_BITS)
            yield codes[inside[:-1] & inside[1:]]


def code_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of the text and their shares, which sum to one."""
    counts = np.zeros(1 << TABLE_BITS, np.int64)
    for codes in subword_codes(text):
        counts += np.bincount(codes, minlength=1 << TABLE_BITS)
    at = np.flatnonzero(counts)
    return at, (counts[at] / max(1, counts.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclasses.dataclass
class Model:
    """``table``: for each subword the logits that it adds, i.e. its embedding times the output weights, and behind
    them 1 for each language whose training texts hold it."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    confidence: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of 1, the log odds, the known share
    threshold: float = 0.0

    def probabilities(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated probability of each language, and the share of subwords known from it."""
        total, n = np.zeros(2 * len(self.languages)), 0
        for codes in subword_codes(text):
            total += self.table[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return self._calibrated(total[None, :] / max(1, n))[0][0], total[len(self.languages) :] / max(1, n)

    def _calibrated(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, known shares) from the means of the table's rows."""
        k = len(self.languages)
        return softmax((means[:, :k] + self.bias) / self.temperature), means[:, k:]

    def sure(self, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How sure the prediction is, 0 to 1: of a text in a learned language near 1."""
        return 1 / (1 + np.exp(-np.clip(_evidence(p, known) @ np.array(self.confidence), -30, 30)))


def _evidence(p: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One row for each text: 1, the log odds of its best language, and what of it that language knows."""
    best = p.argmax(axis=1)
    top = np.clip(p[np.arange(len(p)), best], 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(p)), np.minimum(np.log(top / (1 - top)), 6.0), 10 * known[np.arange(len(p)), best]], 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Row = tuple[np.ndarray, np.ndarray]


def _descend(rows: list[Row], y: np.ndarray, n_languages: int, epochs: int, rate: float, batch: int, seed: int, most_steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and output weights by SGD; the model's table (logits, then known or not) and its bias."""
    rng = np.random.default_rng(seed)
    fit = np.arange(len(rows))
    emb = rng.normal(0, 1 / DIM, (1 << TABLE_BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, n_languages), np.float32)
    bias = np.zeros(n_languages, np.float32)
    a_pass = max(1, -(-len(fit) // batch))
    most = epochs if most_steps is None else max(2, most_steps // a_pass)
    passes = max(min(epochs, most), -(-LEAST_STEPS // a_pass))
    steps, done = passes * a_pass, 0
    for _ in range(passes):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            own = fit[at : at + batch]
            lr = rate * (1 - done / steps)
            done += 1
            mean = np.stack([rows[i][1] @ emb[rows[i][0]] for i in own])
            grad = softmax(mean @ out + bias)
            grad[np.arange(len(own)), y[own]] -= 1
            grad /= len(own)
            back_mean = grad @ out.T
            out -= lr * mean.T @ grad
            bias -= lr * grad.sum(axis=0)
            # A subword's rate grows with its rarity in the batch mean, else embeddings hardly move.
            for i, back in zip(own, back_mean, strict=True):
                emb[rows[i][0]] -= (lr * 20) * rows[i][1][:, None] * back  # a text has each code once
    known = np.zeros((1 << TABLE_BITS, n_languages), np.float32)
    for k in range(n_languages):
        held = np.bincount(np.concatenate([rows[i][0] for i in np.flatnonzero(y == k)] or [np.zeros(0, np.int64)]), minlength=1 << TABLE_BITS)
        known[:, k] = held >= min(2, (y == k).sum())
    return np.concatenate([(emb @ out).astype(np.float32), known], axis=1), bias.astype(np.float64)


def _means(rows: list[Row], table: np.ndarray) -> np.ndarray:
    return np.array([share @ table[codes] for codes, share in rows]).reshape(len(rows), table.shape[1])


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with the letters between its white space and marks in a random order."""
    letters = [c for c in text if c.isalpha()]
    rng.shuffle(letters)
    it = iter(letters)
    return "".join(next(it) if c.isalpha() else c for c in text)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    weight = np.where(y, 1 / max(1, y.sum()), 1 / max(1, (~y).sum())) * len(y) / 2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    return w


def train(texts: list[str], labels: list[str], epochs: int = 8, rate: float = 2.0, batch: int = 16, reject_share: float = 0.002, seed: int = 7) -> Model:
    """Fit by SGD; every fifth row is held back for the temperature, the confidence and the threshold.

    With one language, or too few texts to hold any back, nothing but texts without a letter is rejected.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rows = [code_counts(t) for t in texts]
    back = np.arange(len(rows)) % 5 == 4
    pick = lambda mask: [rows[i] for i in np.flatnonzero(mask)]
    fitted = lambda mask, place, n, most=None: _descend(pick(mask), place[mask], n, epochs, rate, batch, seed, most)
    model = Model(languages, *fitted(~back, y, len(languages)))
    held = back if back.any() else ~back
    means = _means(pick(held), model.table)
    logits = means[:, : len(languages)] + model.bias
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(logits)), y[held]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    if len(languages) < 2 or not back.any():
        return model
    rng = np.random.default_rng(seed)
    noise = [code_counts(_shuffled(texts[i], rng)) for i in np.flatnonzero(back)]
    right, wrong = [], []
    folds = min(FOLDS, len(languages))
    for fold in range(folds):
        others = [k for k in range(len(languages)) if k % folds != fold]
        place = np.searchsorted(others, y)
        mine = y % folds != fold
        if not (~back & mine).any():
            continue
        part = Model(others, *fitted(~back & mine, place, len(others), MOST_STEPS), temperature=model.temperature)
        of = lambda some: _evidence(*part._calibrated(_means(some, part.table)))  # noqa: B023, E731
        p = part._calibrated(_means(pick(back & mine), part.table))[0]
        right.append(of(pick(back & mine))[p.argmax(axis=1) == place[back & mine]])
        wrong += [of(pick(~mine)), of(noise)]
    if not right:
        return model
    x, n_right = np.concatenate([*right, *wrong]), sum(map(len, right))
    is_right = np.arange(len(x)) < n_right
    if n_right and not is_right.all():
        model.confidence = tuple(float(v) for v in _logistic(x, is_right))
        sure = 1 / (1 + np.exp(-np.clip(x[is_right] @ np.array(model.confidence), -30, 30)))
        model.threshold = float(np.quantile(sure, reject_share))
    return model


def sample(labelled: DataFrame, rows_per_language: int, most_chars: int, most_rows: int, most_languages: int) -> tuple[list[str], list[str]]:
    """At most about ``rows_per_language`` different texts of each language, chosen by a hash of the text; a text that repeats counts once.

    Where that would be more than ``most_rows`` in all, every language gets its even part of these.
    """
    rows = labelled.where(F.col("lang").isNotNull() & (F.char_length("text") <= most_chars)).select("text", "lang")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return [], []
    each = max(1, min(rows_per_language, most_rows // len(counts)))
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, each / max(1, r["n"]))) for r in counts], "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("share") * 1_000_003)  # at most most_languages rows
    drawn = near.select("text", "lang").distinct().orderBy(F.xxhash64("text"), "text", "lang")
    got = [r for r in drawn.limit(2 * each * len(counts)).collect() if has_letter(r["text"])]
    return [r["text"] for r in got], [r["lang"] for r in got]


def fit_model(labelled: DataFrame, rows_per_language: int = 250, most_chars: int = 50_000, most_rows: int = 50_000, most_languages: int = 10_000) -> Model:
    """Train on a sample of ``labelled`` (text, lang).

    What reaches the driver is bounded: ``rows_per_language`` different texts of each language, ``most_rows`` in all, of at most ``most_chars``
    characters each.  There are under 8,000 languages in the registers of languages; of more than ``most_languages`` values of ``lang`` the most frequent are learned.
    """
    texts, labels = sample(labelled, rows_per_language, most_chars, most_rows, most_languages)
    return train(texts, labels) if texts else Model([UNKNOWN], np.zeros((1 << TABLE_BITS, 2), np.float32), np.zeros(1))


def judge(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text.

    A null text and one without a letter are ``und`` with score 0 and rejected.  Any other text
    gets a learned language, of equally likely ones the first by name; it is rejected if its calibrated confidence is under the threshold, as noise and
    texts in other languages are.
    """
    if not has_letter(text):
        return UNKNOWN, 0.0, True
    p, known = model.probabilities(text)
    k = int(p.argmax())
    return model.languages[k], float(p[k]), bool(model.sure(p[None, :], known[None, :])[0] < model.threshold)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs``; see ``judge``.

    The model is a table of fixed size (2^15 rows), which is what is sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py(), shared.value) for t in batch.column(1)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns and no other."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not judge(t.as_py(), shared.value)[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, labelled: DataFrame, rows_per_language: int = 250) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs``, learning from ``labelled`` (text, lang).

    Rows that repeat get equal results, a null ``doc_id`` stays null, other columns are left out.  Without any
    labelled text every text is ``und``, and only texts without a letter are rejected.
    """
    return predict(docs, fit_model(labelled, rows_per_language))
