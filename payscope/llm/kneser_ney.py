"""Interpolated modified Kneser-Ney language model (operator 7).

Bigrams, or trigrams, are counted in Spark over all training documents: every task turns its texts into sorted,
packed runs of hashed counts, one for each partition of the hash space, and the partitions are merged after
a shuffle.  The model is written as sorted hash arrays, one pair of files for each partition, which
the scoring workers memory-map; nothing that grows with the corpus is collected or broadcast.
A trigram is kept in the partition of its last two words, so that the bigrams' continuation counts are
found there and only the sums of histories that end in a hot word are shuffled once more.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import materialize, rows_of, scratch_path
from payscope.llm.shared_files import mapped, save
from payscope.llm.sorted_runs import RUN_ROWS, by_part, pack, part_slices, run_rows, unpack

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of text that make one sorted run, and one block of scoring.
RUN_BYTES = 20 << 20
BLOCK_BYTES = 8 << 20
#: Bytes of text whose counts are merged by one task.
PART_BYTES = 128 << 20
_HASH_BITS = 56
BEGIN, END = np.uint64(1), np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Statistics of a word: its count; as a history the tokens that follow, and how many words follow once, twice, more
#: often; and how many different words it follows.
WORD_FIELDS = ("count", "after", "n1", "n2", "n3", "before")


def token_hashes(text: str | None) -> np.ndarray:
    """56-bit hashes of the words, then the end token."""
    h = xxhash.xxh64_intdigest
    words = (text or "").encode().translate(_LOWER).split()
    out = np.fromiter((h(w) for w in words), np.uint64, len(words)) >> np.uint64(64 - _HASH_BITS)
    return np.append(out, END)


def _mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v * _MIX) ^ (w + (v >> np.uint64(29)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def histories(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words before each token (BEGIN at the start of a document), and the tokens."""
    w = np.concatenate(tokens)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.cumsum([0, *map(len, tokens[:-1])])] = BEGIN
    return v, w


def earlier(tokens: list[np.ndarray], v: np.ndarray) -> np.ndarray:
    """The words before the histories ``v`` (BEGIN at the first two tokens of a document)."""
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[np.cumsum([0, *map(len, tokens[:-1])])] = BEGIN
    return u


def _context(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of two words."""
    return _mix(u + _MIX, v)


@dataclasses.dataclass
class Layout:
    """Where a bigram and a word live: the partition is the top bits of a hash; bigrams of very
    frequent histories are spread by both words."""

    bits: int
    hot: np.ndarray

    def of_pairs(self, v: np.ndarray, key: np.ndarray) -> np.ndarray:
        own = self.of_words(v)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            own = np.where(self.hot[at] == v, (key >> np.uint64(64 - self.bits)) if self.bits else 0, own)
        return own.astype(np.uint16 if self.bits <= 16 else np.uint32)

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        return np.isin(v, self.hot)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        part = ((w * _MIX) >> np.uint64(64 - self.bits)) if self.bits else np.zeros_like(w)
        return part.astype(np.uint16 if self.bits <= 16 else np.uint32)


def _planes(x: np.ndarray) -> np.ndarray:
    """The low 7 bytes of each value, which is all a hash has."""
    return x.view(np.uint8).reshape(-1, 8)[:, :7].reshape(-1)


def _from_planes(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = b.reshape(-1, 7)
    return out.reshape(-1).view(np.uint64)


def _triple_runs(tokens: list[np.ndarray], layout: Layout) -> Iterator[tuple[int, str, bytes]]:
    """Sorted runs of the trigrams, cut by partition: the first words by bigram, those by history."""
    v, w = histories(tokens)
    u = earlier(tokens, v)
    ranked = _mix(_context(u, v), w)
    order = np.argsort(ranked)
    ranked = ranked[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    count = np.diff(np.r_[first, len(ranked)]).astype(np.uint32)
    u, v, w = (x[order[first]] for x in (u, v, w))
    part = layout.of_pairs(v, _mix(v, w))
    order = np.lexsort((w, v, part))
    part, u, v, w, count = (x[order] for x in (part, u, v, w, count))
    for p, s in part_slices(part):
        pairs = np.flatnonzero(np.r_[True, (v[s][1:] != v[s][:-1]) | (w[s][1:] != w[s][:-1])])
        many = np.diff(np.r_[pairs, s.stop - s.start]).astype(np.uint32)
        own = v[s][pairs]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[starts, len(own)]).astype(np.uint32)
        yield p, "triples", pack(v=np.diff(own[starts], prepend=np.uint64(0)), n=sizes, w=_planes(np.ascontiguousarray(w[s][pairs])), m=many, u=_planes(np.ascontiguousarray(u[s])), c=count[s])


def _counted_runs(tokens: list[np.ndarray], layout: Layout, size: int = 2) -> Iterator[tuple[int, str, bytes]]:
    """Sorted runs of one block of documents, cut by partition: bigrams by history, or trigrams, and words."""
    yield from _pair_runs(tokens, layout) if size == 2 else _triple_runs(tokens, layout)
    words, counts = np.unique(np.concatenate(tokens), return_counts=True)
    part = layout.of_words(words)
    order = np.argsort(part, kind="stable")
    for p, s in part_slices(part[order]):
        own = order[s]
        yield p, "words", pack(w=words[own], count=counts[own].astype(np.uint64))


def _pair_runs(tokens: list[np.ndarray], layout: Layout) -> Iterator[tuple[int, str, bytes]]:
    v, w = histories(tokens)
    key = _mix(v, w)
    order = np.argsort(key)
    ranked = key[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    count = np.diff(np.r_[first, len(ranked)]).astype(np.uint32)
    own = order[first]
    v, w, key = v[own], w[own], ranked[first]
    order = np.argsort(v)
    v, w, key, count = v[order], w[order], key[order], count[order]
    part = layout.of_pairs(v, key)
    order = np.argsort(part, kind="stable")
    part, v, w, count = part[order], v[order], w[order], count[order]
    for p, s in part_slices(part):
        starts = np.flatnonzero(np.r_[True, v[s][1:] != v[s][:-1]])
        sizes = np.diff(np.r_[starts, s.stop - s.start]).astype(np.uint32)
        yield p, "pairs", pack(v=np.diff(v[s][starts], prepend=np.uint64(0)), n=sizes, w=_planes(np.ascontiguousarray(w[s])), c=count[s])


def _sum_by(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, int)
    return ranked[at], [np.add.reduceat(x[order], at) if len(at) else x[:0] for x in values]


def _merge_pairs(runs: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = np.concatenate([np.repeat(np.cumsum(r["v"]), r["n"]) for r in runs])
    w = np.concatenate([_from_planes(r["w"]) for r in runs])
    c = np.concatenate([r["c"] for r in runs]).astype(np.uint64)
    key = _mix(v, w)
    order = np.argsort(key)
    ranked = key[order]
    at = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    return ranked[at], v[order[at]], w[order[at]], np.add.reduceat(c[order], at)


def _merge_triples(runs: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Keys, histories' hashes, last two words and counts of the trigrams, by key."""
    w = np.concatenate([np.repeat(_from_planes(r["w"]), r["m"]) for r in runs])
    v = np.concatenate([np.repeat(np.repeat(np.cumsum(r["v"]), r["n"]), r["m"]) for r in runs])
    context = _context(np.concatenate([_from_planes(r["u"]) for r in runs]), v)
    c = np.concatenate([r["c"] for r in runs]).astype(np.uint64)
    key = _mix(context, w)
    order = np.argsort(key)
    ranked = key[order]
    at = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    own = order[at]
    return ranked[at], context[own], v[own], w[own], np.add.reduceat(c[order], at)


def _distinct_pairs(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, words and continuation counts of the bigrams that end distinct trigrams, by key."""
    key, at, c = np.unique(_mix(v, w), return_index=True, return_counts=True)
    return key, v[at], w[at], c.astype(np.uint64)


def _save_counts(name: str, key: np.ndarray, c: np.ndarray) -> None:
    big = np.flatnonzero(c >= 65535)
    save(f"{name}.key", key.tobytes())
    save(f"{name}.count", np.minimum(c, 65535).astype(np.uint16).tobytes())
    save(f"{name}.big", np.stack([big.astype(np.uint64), c[big]], 1).tobytes())


def _history_sums(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each history the tokens that follow, and how many words follow once, twice, more often."""
    return _sum_by(v, [c, (c == 1).astype(np.uint64), (c == 2).astype(np.uint64), (c > 2).astype(np.uint64)])


def _types(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)] + [len(c)], np.int64)


@dataclasses.dataclass
class Model:
    """What the driver holds of the model: where its files are, and a few sums."""

    uri: str
    layout: Layout
    tokens: int
    words: int
    types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float
    triple_discounts: tuple[float, float, float] | None = None  # of trigrams only


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of types seen one to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.01 * k), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))  # type: ignore[return-value]


def corpus_size(docs: DataFrame, share: float = 0.002) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and hashes of the words that make ``share`` of all tokens (they only decide where counts are kept).

    Both are of one pass over all rows; a sketch of bounded size in each task finds the words.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    found = words.where("w <> ''").agg(F.expr(f"approx_top_k(w, {int(1 / share)}, {int(20 / share)})").alias("top"), F.count("*").alias("n")).first()
    hot = [token_hashes(x["item"])[0] for x in found["top"] or [] if x["item"] and x["count"] >= share * found["n"]]
    return size, np.unique(np.array([*hot, BEGIN], np.uint64))


def build_model(docs: DataFrame, order: int = 2) -> Model:
    """Count all of ``docs`` (text) and write the model of ``order`` 2 or 3 to the shared folder."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    size, hot_words = corpus_size(docs)
    # As many partitions as shuffles have, or more, so that the runs of one, which a task holds, come from so many bytes of text.
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    bits = max(0, (least - 1).bit_length())
    layout = Layout(bits, hot_words)
    uri = scratch_path(spark, "kneser-ney")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows_of(batches, ["text"], len, RUN_BYTES):
            tokens = [token_hashes(t) for t in texts]
            texts.clear()
            yield run_rows(list(_counted_runs(tokens, layout, order)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bigram arrays of each partition go to files; word counts and what bigrams say of words go on."""
        for part, runs in by_part(batches):
            out: list[tuple[int, str, bytes]] = []
            pairs = [unpack(r) for kind, r in runs if kind in ("pairs", "triples")]
            if pairs:
                if order == 3:
                    key, context, v, w, c = _merge_triples(pairs)
                    pairs.clear()
                    _save_counts(f"{uri}/triples-{part}", key, c)
                    out.append((0, "types3", pack(n=_types(c))))
                    hot = layout.is_hot(v)
                    held, sums = _history_sums(context[~hot], c[~hot])
                    save(f"{uri}/contexts-{part}.key", held.tobytes())
                    save(f"{uri}/contexts-{part}.table", np.stack(sums, 1).astype(np.uint32).tobytes())
                    held, sums = _history_sums(context[hot], c[hot])
                    where = layout.of_words(held)
                    by = np.argsort(where, kind="stable")
                    for p, s in part_slices(where[by]):
                        out.append((p, "context", pack(w=held[by[s]], **{k: x[by[s]] for k, x in zip(WORD_FIELDS[1:5], sums, strict=True)})))
                    del key, context, held, sums, hot
                    key, v, w, c = _distinct_pairs(v, w)
                else:
                    key, v, w, c = _merge_pairs(pairs)
                _save_counts(f"{uri}/pairs-{part}", key, c)
                words, (after, n1, n2, n3) = _history_sums(v, c)
                where = layout.of_words(words)
                by = np.argsort(where, kind="stable")
                for p, s in part_slices(where[by]):
                    own = by[s]
                    out.append((p, "history", pack(w=words[own], after=after[own], n1=n1[own], n2=n2[own], n3=n3[own])))
                words, before = np.unique(w, return_counts=True)
                where = layout.of_words(words)
                by = np.argsort(where, kind="stable")
                for p, s in part_slices(where[by]):
                    out.append((p, "follows", pack(w=words[by[s]], before=before[by[s]].astype(np.uint64))))
                out.append((0, "types", pack(n=_types(c))))
            counts = [unpack(r) for kind, r in runs if kind == "words"]
            if counts:
                words, (n,) = _sum_by(np.concatenate([r["w"] for r in counts]), [np.concatenate([r["count"] for r in counts])])
                out.append((part, "counts", pack(w=words, count=n)))
            yield run_rows(out)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word arrays of each partition go to files; sums over them come out."""
        for part, runs in by_part(batches):
            got = [unpack(r) for kind, r in runs if kind not in ("types", "types3", "context")]
            sums, sums3 = (sum((unpack(r)["n"] for kind, r in runs if kind == name), np.zeros(5, np.int64)) for name in ("types", "types3"))
            contexts = [unpack(r) for kind, r in runs if kind == "context"]
            if contexts:
                held, totals = _sum_by(*(lambda k, *x: (k, [*x]))(*(np.concatenate([r[f] for r in contexts]) for f in ("w", *WORD_FIELDS[1:5]))))
                save(f"{uri}/hot-{part}.key", held.tobytes())
                save(f"{uri}/hot-{part}.table", np.stack(totals, 1).tobytes())
            key = np.unique(np.concatenate([r["w"] for r in got])) if got else np.zeros(0, np.uint64)
            table = np.zeros((len(key), len(WORD_FIELDS)), np.uint64)
            for r in got:
                at = np.searchsorted(key, r["w"])
                for k, field in enumerate(WORD_FIELDS):
                    if field in r:
                        table[at, k] += r[field]
            save(f"{uri}/words-{part}.key", key.tobytes())
            save(f"{uri}/words-{part}.table", table.tobytes())
            count, before = table[:, 0], table[:, 5]
            values = [count.sum(), (count > 0).sum(), *sums, *((before == k).sum() for k in (1, 2, 3, 4)), (before > 2).sum(), *sums3]
            yield pa.record_batch([pa.array([[int(x) for x in values]], pa.list_(pa.int64()))], names=["sums"])

    parts = 1 << bits
    runs = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, RUN_ROWS).repartitionById(parts, "part").sortWithinPartitions("part")
    merged = materialize(runs.mapInArrow(merge, RUN_ROWS), "kneser-ney-words")
    sums = merged.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(words, "sums array<long>")
    total = sums.select(*(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(17))).first()
    s = [int(x or 0) for x in total]
    discounts = _discounts(s[7:11])
    rest = (discounts[0] * s[7] + discounts[1] * s[8] + discounts[2] * s[11]) / s[6] if s[6] else 1.0
    return Model(uri, layout, s[0], s[1], s[6], _discounts(s[2:6]), discounts, rest, _discounts(s[12:16]) if order == 3 else None)


class _Reader:
    """The model's files, mapped when first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.files = model, {}

    def _file(self, name: str, kind: type) -> np.ndarray:
        if name not in self.files:
            self.files[name] = mapped(f"{self.model.uri}/{name}", kind)
        return self.files[name]

    def words(self, w: np.ndarray) -> np.ndarray:
        """The statistics of distinct words, one row each."""
        out = np.zeros((len(w), len(WORD_FIELDS)), np.float64)
        part = self.model.layout.of_words(w)
        order = np.argsort(part, kind="stable")
        for p, s in part_slices(part[order]):
            key = self._file(f"words-{p}.key", np.uint64)
            if len(key):
                own = order[s]
                at = np.minimum(np.searchsorted(key, w[own]), len(key) - 1)
                hit = key[at] == w[own]
                out[own[hit]] = self._file(f"words-{p}.table", np.uint64).reshape(-1, len(WORD_FIELDS))[at[hit]]
        return out

    def contexts(self, context: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The sums of distinct histories of two words, one row each; ``v`` is the second word."""
        layout = self.model.layout
        out, hot = np.zeros((len(v), 4)), layout.is_hot(v)
        for name, kind, chosen, part in (("contexts", np.uint32, ~hot, layout.of_words(v)), ("hot", np.uint64, hot, layout.of_words(context))):
            chosen = np.flatnonzero(chosen)
            chosen = chosen[np.argsort(part[chosen], kind="stable")]
            for p, s in part_slices(part[chosen]):
                key, own = self._file(f"{name}-{p}.key", np.uint64), chosen[s]
                if len(key):
                    at = np.minimum(np.searchsorted(key, context[own]), len(key) - 1)
                    hit = key[at] == context[own]
                    out[own[hit]] = self._file(f"{name}-{p}.table", kind).reshape(-1, 4)[at[hit]]
        return out

    def counts(self, name: str, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The counts of distinct bigrams ("pairs") or trigrams ("triples"), given in ascending order of their keys."""
        out = np.zeros(len(key))
        order = np.argsort(part, kind="stable")
        for p, s in part_slices(part[order]):
            keys = self._file(f"{name}-{p}.key", np.uint64)
            if len(keys):
                own = order[s]
                at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
                hit = keys[at] == key[own]
                count = self._file(f"{name}-{p}.count", np.uint16)[at[hit]].astype(np.float64)
                big = self._file(f"{name}-{p}.big", np.uint64).reshape(-1, 2)
                if len(big):
                    full = np.flatnonzero(count == 65535)
                    count[full] = big[np.searchsorted(big[:, 0], at[hit][full].astype(np.uint64)), 1]
                out[own[hit]] = count
        return out

    def score(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each document: tokens, known tokens, base score, model score."""
        m = self.model
        v, w = histories(tokens)
        words, at = np.unique(w, return_inverse=True)
        own = self.words(words)
        seen = own[:, 0]
        base = np.log10((seen + 1) / (m.tokens + m.words + 1))
        d = np.array([0.0, *m.word_discounts])
        before = own[:, 5]
        unigram = np.maximum(before - d[np.minimum(before, 3).astype(int)], 0) / max(1, m.types) + m.word_rest / (m.words + 1)
        key = _mix(v, w)
        order = np.argsort(key)
        ranked = key[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        one = order[first]
        count = self.counts("pairs", ranked[first], m.layout.of_pairs(v[one], ranked[first]))
        before_words, which = np.unique(v[one], return_inverse=True)
        history = self.words(before_words)[which]
        after = history[:, 1]
        d = np.array([0.0, *m.pair_discounts])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.maximum(count - d[np.minimum(count, 3).astype(int)], 0) / after
            p += (history[:, 2:5] @ np.array(m.pair_discounts)) / after * unigram[at[one]]
        p = np.where(after > 0, p, unigram[at[one]])
        each = np.empty(len(w))
        each[order] = np.repeat(p, np.diff(np.r_[first, len(ranked)]))
        if m.triple_discounts:
            each = self._triples(earlier(tokens, v), v, w, key, each)
        each = np.log10(each)
        starts = np.cumsum([0, *map(len, tokens[:-1])])
        add = lambda x: np.add.reduceat(x, starts)
        return np.array([len(t) for t in tokens]), add((seen[at] > 0).astype(np.int64)), add(base[at]), add(each)


    def _triples(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, pair: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The probability of each token after two words, from that after one."""
        context = _context(u, v)
        key, one, at = np.unique(_mix(context, w), return_index=True, return_inverse=True)
        count = self.counts("triples", key, self.model.layout.of_pairs(v[one], pair[one]))
        _, first, which = np.unique(context[one], return_index=True, return_inverse=True)
        history = self.contexts(context[one][first], v[one][first])[which]
        after, d = history[:, 0], np.array([0.0, *self.model.triple_discounts])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.maximum(count - d[np.minimum(count, 3).astype(int)], 0) / after + (history[:, 1:] @ d[1:]) / after * lower[one]
        return np.where(after > 0, p, lower[one])[at]


def score_documents(docs: DataFrame, training: Column, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    ``training`` says which rows the model learns from, ``order`` whether it knows one word of history or two.  A null or empty text is the end token
    alone.  Rows that repeat are scored, and counted, each for itself; a null ``doc_id`` stays null, other columns are left
    out.  Without training rows every token is unknown and scores are finite.  Words are told apart by 56 bits of
    their hash: of a billion different words about seven pairs would be taken for one.
    """
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~training).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = build_model(flagged.where("NOT held_out").select("text"), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(model)
        for ids, held, texts in rows_of(batches, ["doc_id", "held_out", "text"], len, BLOCK_BYTES):
            n, known, base, score = reader.score([token_hashes(t) for t in texts])
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * len(ids), pa.int64()), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return flagged.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
