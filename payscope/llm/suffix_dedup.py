"""Removal of repeated strings by a distributed merge sort of suffixes (operator 2).

A string of ``length`` bytes is a repeat if it also starts earlier.  Every such string chooses, by its
own bytes alone, one place in it: the least hash of its first half.  So equal strings choose the same
place, and it is enough to sort the suffixes that start at chosen places, about one in 27 bytes.

1. Fingerprints of the bytes that follow each chosen place are exchanged, and those that occur
   only once are left out: no string around them repeats.
2. The other suffixes, each with the bytes before it that matter, are sorted within each block of
   text, front-coded, exchanged and merged by a loser tree that skips known prefixes.  Equal ones
   follow each other, and all but the first of them are repeats as a whole.  Neighbours that share only a
   prefix are compared string by string.
3. Where very many different suffixes share that prefix, they are spread over all partitions
   in step 2 and their strings go through the same sort once more, each as a suffix of its own.

Earlier means: a smaller doc_id, or an earlier start in the same document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import materialize, rows_of, scratch_path
from payscope.llm.shared_files import mapped, save
from payscope.llm.sorted_runs import RUN_ROWS, by_part, front_coded, merged, pack, part_slices, run_rows, sorted_order, unpack

LENGTH = 100
#: Characters of text in one sorted run.
BLOCK = 8 << 20
#: Suffixes in one sorted run.
RUN_ROWS_MOST = 1 << 18
#: So many occurrences of a prefix are compared in one task; of more, the strings are spread.
HOT = 8192
#: A null doc_id comes after all others.
NO_ID = (1 << 63) - 1
_HASH_BITS = 48
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_COVERS = "doc_id long, text_hash long, spans binary"


def window_of(length: int) -> int:
    """From how many first bytes of a string the place is chosen."""
    return length // 2 + 2


class Block:
    """Texts laid end to end, in the order of their documents."""

    def __init__(self, ids: list[int], hashes: list[int], texts: list[str | None], length: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i], hashes[i]))
        # A row that repeats as a whole is the same document, not an earlier one.
        order = [i for n, i in enumerate(order) if not n or (ids[i], hashes[i]) != (ids[order[n - 1]], hashes[order[n - 1]])]
        raw = [(texts[i] or "").encode() for i in order]
        self.length, self.window = length, window_of(length)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.hashes = np.array([hashes[i] for i in order], np.int64)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        self.starts = self.ends - np.array([len(r) for r in raw], np.int64)
        self.bytes = np.frombuffer(b"".join(raw) + bytes(length + 16), np.uint8)
        self.words = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        self._choose(int(self.ends[-1]) if len(raw) else 0)

    def _choose(self, n: int) -> None:
        """Chosen places ``at``; the strings that choose one start from ``low`` to ``high``."""
        last = np.repeat((self.ends - self.length).astype(np.int32), np.diff(self.ends, prepend=0))
        lows, highs, places = [], [], []
        step = 1 << 21
        for a in range(0, n, step):
            b = min(n, a + step)
            start = np.flatnonzero(np.arange(a, b, dtype=np.int32) <= last[a:b])
            if not len(start):
                continue
            size = b - a + self.window - 1
            least = (self.words[a : a + size] * _M1 >> np.uint64(32) << np.uint64(32)) | np.arange(size, dtype=np.uint64)
            width = 1
            while 2 * width <= self.window:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < self.window:
                more = self.window - width
                least = np.minimum(least[:-more], least[more:])
            chosen = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
            start = start + a
            first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)])
            lows.append(start[first])
            highs.append(start[np.r_[first[1:] - 1, len(start) - 1]])
            places.append(chosen[first])
        none = np.zeros(0, np.int64)
        low, high, at = (np.concatenate(x) if x else none for x in (lows, highs, places))
        doc = np.searchsorted(self.ends, low, "right")
        if len(at):  # slices cut the strings of one place in two
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
            low, high, at, doc = low[first], high[np.r_[first[1:] - 1, len(at) - 1]], at[first], doc[first]
        self.low, self.high, self.at, self.doc = low, high, at, doc

    def prefix_hashes(self) -> np.ndarray:
        """Hashes of the bytes after each place that all strings that chose it hold."""
        size = self.length - self.window + 1
        h = np.full(len(self.at), size, np.uint64)
        for o in [*range(0, size - 8, 8), size - 8]:
            h = (h ^ self.words[self.at + o]) * _M1
            h ^= h >> np.uint64(29)
        h *= _M2
        return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - _HASH_BITS)

    def keys(self, own: np.ndarray) -> np.ndarray:
        """What is sorted: the suffix as far as it matters, the bytes before it from near to far, and both lengths."""
        after, before = self.high[own] + self.length - self.at[own], self.at[own] - self.low[own]
        out = np.zeros((len(own), key_width(self.length)), np.uint8)
        k = np.arange(self.length)
        for a in range(0, len(own), 16384):
            s = slice(a, a + 16384)
            at = self.at[own[s], None]
            out[s, : self.length] = np.where(k < after[s, None], self.bytes[at + k], 0)
            back = np.arange(self.window - 1)
            out[s, self.length : -2] = np.where(back < before[s, None], self.bytes[np.maximum(at - 1 - back, 0)], 0)
        out[:, -2] = before
        out[:, -1] = after
        return out


def key_width(length: int) -> int:
    return length + window_of(length) - 1 + 2


def _spread(keys: np.ndarray) -> np.ndarray:
    """Hashes of whole keys."""
    wide = np.zeros((len(keys), -(-keys.shape[1] // 8) * 8), np.uint8)
    wide[:, : keys.shape[1]] = keys
    words, h = wide.view(np.uint64), np.zeros(len(keys), np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * _M1
        h ^= h >> np.uint64(29)
    return h * _M2


def _part(hashes: np.ndarray, bits: int, of: int = 64) -> np.ndarray:
    return (hashes >> np.uint64(of - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)


class Covers:
    """Stretches of documents found to be repeats, gathered by document."""

    def __init__(self) -> None:
        self.found: dict[tuple[int, int], list[int]] = {}
        self.size = 0

    def add(self, doc: tuple[int, int], start: int, end: int) -> None:
        own = self.found.setdefault(doc, [])
        if own and own[-1] >= start >= own[-2]:
            own[-1] = max(own[-1], end)
        else:
            own += (start, end)
            self.size += 1

    def rows(self, bits: int) -> list[tuple[int, str, bytes]]:
        """What was gathered, packed for each partition of the documents; nothing is held after that."""
        docs = list(self.found)
        ids, hashes = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
        spans = [np.array(self.found[d], np.uint32) for d in docs]
        self.found, self.size = {}, 0
        part = _part((hashes.view(np.uint64) ^ ids.view(np.uint64)) * _M1, bits)
        order, out = np.argsort(part, kind="stable"), []
        for p, s in part_slices(part[order]):
            own = order[s]
            out.append((p, "covers", pack(ids=ids[own], hashes=hashes[own], sizes=np.array([len(spans[i]) for i in own], np.uint32), spans=np.concatenate([spans[i] for i in own]))))
        return out


def _sorted_runs(keys: np.ndarray, part: np.ndarray, kind: str, ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, repeated: Callable[[np.ndarray], None]) -> Iterator[tuple[int, str, bytes]]:
    """Runs of the distinct keys for each partition.  The keys come in the order of their documents; of
    equal ones the first stays and the others are handed to ``repeated``."""
    if not len(keys):
        return
    order = sorted_order(keys)
    keys = keys[order]
    first = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
    repeated(order[~first])
    own, keys = order[first], keys[first]
    by = np.argsort(part[own], kind="stable")
    own, keys = own[by], keys[by]
    for p, s in part_slices(part[own]):
        used, which = np.unique(doc[own[s]], return_inverse=True)
        yield p, kind, front_coded(keys[s], doc=which.astype(np.uint32), place=place[own[s]].astype(np.uint32), ids=ids[used], hashes=hashes[used])


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Block]:
    for ids, hashes, texts in rows_of(batches, ["doc_id", "text_hash", "text"], len, BLOCK):
        yield Block(ids, hashes, texts, length)


def repeated_prefixes(docs: DataFrame, length: int, bits: int) -> str:
    """Step 1: the folder with the prefix hashes that occur more than once, a sorted file for each
    partition (each hash doubled, plus one if it occurs more than HOT times)."""
    uri = scratch_path(docs.sparkSession, "suffix-prefixes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, length):
            found, times = np.unique(block.prefix_hashes(), return_counts=True)
            out = []
            for p, s in part_slices(_part(found, bits, _HASH_BITS)):
                step = np.diff(found[s], prepend=np.uint64(0))
                planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :6].T).reshape(-1)
                again = np.flatnonzero(times[s] > 1).astype(np.uint32)
                out.append((p, "hashes", pack(step=planes, again=again, times=times[s][again].astype(np.uint32))))
            yield run_rows(out)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for part, runs in by_part(batches):
            hashes, times = [], []
            for _, run in runs:
                r = unpack(run)
                planes = np.zeros((len(r["step"]) // 6, 8), np.uint8)
                planes[:, :6] = r["step"].reshape(6, -1).T
                hashes.append(np.cumsum(planes.view(np.uint64).reshape(-1), dtype=np.uint64))
                t = np.ones(len(planes), np.int64)
                t[r["again"]] = r["times"]
                times.append(t)
            h, t = np.concatenate(hashes), np.concatenate(times)
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
            t = np.add.reduceat(t[order], at) if len(at) else t
            kept = t > 1
            save(f"{uri}/repeated-{part}", (h[at][kept] * np.uint64(2) + (t[kept] > HOT).astype(np.uint64)).tobytes())
            n += int(kept.sum())
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    runs = docs.mapInArrow(count, RUN_ROWS).repartitionById(1 << bits, "part").sortWithinPartitions("part")
    runs.mapInArrow(repeated, "n long").agg(F.sum("n")).first()
    return uri


def _marked(uri: str, hashes: np.ndarray, bits: int, files: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are repeated, and which of them are hot."""
    repeated, hot = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    part = _part(hashes, bits, _HASH_BITS)
    order = np.argsort(part, kind="stable")
    for p, s in part_slices(part[order]):
        if p not in files:
            files[p] = mapped(f"{uri}/repeated-{p}", np.uint64)
        known = files[p]
        if len(known):
            own = order[s]
            at = np.minimum(np.searchsorted(known, hashes[own] * np.uint64(2)), len(known) - 1)
            hit = known[at] >> np.uint64(1) == hashes[own]
            repeated[own[hit]] = True
            hot[own[hit]] = (known[at[hit]] & np.uint64(1)) == 1
    return repeated, hot


def _settle(group: list[tuple[tuple[int, int, int], bytes]], length: int, covers: Covers) -> None:
    """Different suffixes with a common prefix: which of their strings start earlier in another."""
    seen: set[bytes] = set()
    for (doc, text_hash, at), key in sorted(group):
        before = key[-2]
        text = key[length : length + before][::-1] + key[: key[-1]]
        for k in range(len(text) - length + 1):
            string = text[k : k + length]
            if string in seen:
                covers.add((doc, text_hash), at - before + k, at - before + k + length)
            else:
                seen.add(string)


class _Places:
    """Where the strings of the runs start."""

    def __init__(self, runs: list[dict[str, np.ndarray]]) -> None:
        self.tables = [(r["doc"].tolist(), r["place"].tolist(), r["ids"].tolist(), r["hashes"].tolist()) for r in runs]

    def of(self, run: int, at: int) -> tuple[int, int, int]:
        doc, place, ids, hashes = self.tables[run]
        d = doc[at]
        return ids[d], hashes[d], place[at]


def _merge_kind(runs: list[dict[str, np.ndarray]], width: int) -> Iterator[tuple[bytes, int, list[tuple[int, int, int]]]]:
    """(key, bytes shared with the key before, where it occurs: the first of each run)."""
    places = _Places(runs)
    last, shared, where = b"", 0, []
    for key, n, run, at in merged(runs, width):
        if n == width and where:
            where.append(places.of(run, at))
            continue
        if where:
            yield last, shared, where
        last, shared, where = key, n, [places.of(run, at)]
    if where:
        yield last, shared, where


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, spans): the bytes of each document that repeats cover, as packed pairs of start and
    end of maximal runs; one row for a document that has any.  ``docs``: doc_id, text_hash, text."""
    if length < 32 or length > 160:
        raise ValueError("length: 32 to 160 bytes")
    spark = docs.sparkSession
    bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    uri = repeated_prefixes(docs, length, bits)
    width, prefix = key_width(length), length - window_of(length) + 1

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, np.ndarray] = {}
        for block in _blocks(batches, length):
            hashes = block.prefix_hashes()
            repeated, hot = _marked(uri, hashes, bits, files)
            places = block.at - block.starts[block.doc]
            covers = Covers()

            def cover(which: np.ndarray, block: Block = block, covers: Covers = covers) -> None:
                for i in np.sort(which).tolist():
                    d = block.doc[i]
                    start = block.starts[d]
                    covers.add((int(block.ids[d]), int(block.hashes[d])), int(block.low[i] - start), int(block.high[i] + length - start))

            for kind, which in (("suffixes", repeated & ~hot), ("hot", repeated & hot)):
                which = np.flatnonzero(which)
                for k in range(0, len(which), RUN_ROWS_MOST):
                    own = which[k : k + RUN_ROWS_MOST]
                    keys = block.keys(own)
                    part = _part(_spread(keys), bits) if kind == "hot" else _part(hashes[own], bits, _HASH_BITS)
                    yield run_rows(list(_sorted_runs(keys, part, kind, block.ids, block.hashes, block.doc[own], places[own], lambda w, own=own, cover=cover: cover(own[w]))))
            yield run_rows(covers.rows(bits))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            covers = Covers()
            yield run_rows([(part, kind, run) for kind, run in rows if kind == "covers"])
            runs = [unpack(run) for kind, run in rows if kind == "suffixes"]
            group: list[tuple[tuple[int, int, int], bytes]] = []
            for key, shared, where in _merge_kind(runs, width) if runs else ():
                first = min(where)
                for doc, text_hash, at in where:
                    if (doc, text_hash, at) != first:
                        covers.add((doc, text_hash), at - key[-2], at + key[-1])
                if shared < prefix:
                    if len(group) > 1:
                        _settle(group, length, covers)
                    group = []
                group.append((first, key))
                if covers.size > 1_000_000:
                    yield run_rows(covers.rows(bits))
            if len(group) > 1:
                _settle(group, length, covers)
            yield from hot_strings([unpack(run) for kind, run in rows if kind == "hot"], covers)
            yield run_rows(covers.rows(bits))

    def hot_strings(runs: list[dict[str, np.ndarray]], covers: Covers) -> Iterator[pa.RecordBatch]:
        """Step 3: of each different suffix of a hot prefix, its strings, sorted anew."""
        held: list[tuple[tuple[int, int, int], bytes]] = []
        for key, _, where in _merge_kind(runs, width) if runs else ():
            first = min(where)
            for doc, text_hash, at in where:
                if (doc, text_hash, at) != first:
                    covers.add((doc, text_hash), at - key[-2], at + key[-1])
            held.append((first, key))
            if len(held) >= 8192:
                yield strings_of(held)
                held = []
        if held:
            yield strings_of(held)

    def strings_of(held: list[tuple[tuple[int, int, int], bytes]]) -> pa.RecordBatch:
        held.sort()
        places, strings, docs_of = [], [], []
        for n, ((_, _, at), key) in enumerate(held):
            before = key[-2]
            text = key[length : length + before][::-1] + key[: key[-1]]
            for k in range(len(text) - length + 1):
                strings.append(text[k : k + length])
                places.append(at - before + k)
                docs_of.append(n)
        # a last byte that isn't zero
        keys = np.ones((len(strings), length + 1), np.uint8)
        keys[:, :length] = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, length)
        ids = np.array([x[0][0] for x in held], np.int64)
        hashes = np.array([x[0][1] for x in held], np.int64)
        covers, place, doc = Covers(), np.array(places, np.int64), np.array(docs_of, np.int64)

        def cover(which: np.ndarray) -> None:
            for i in np.sort(which).tolist():
                covers.add((int(ids[doc[i]]), int(hashes[doc[i]])), int(place[i]), int(place[i]) + length)

        out = list(_sorted_runs(keys, _part(_spread(keys), bits), "strings", ids, hashes, doc, place, cover))
        return run_rows(out + covers.rows(bits))

    def merge_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            covers = Covers()
            for _, _, where in _merge_kind([unpack(run) for _, run in rows], length + 1):
                first = min(where)
                for doc, text_hash, at in where:
                    if (doc, text_hash, at) != first:
                        covers.add((doc, text_hash), at, at + length)
            yield run_rows(covers.rows(bits))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document of a partition that has any cover."""
        for _, rows in by_part(batches):
            spans: dict[tuple[int, int], list[np.ndarray]] = {}
            for _, run in rows:
                r = unpack(run)
                ends = np.cumsum(r["sizes"])
                for doc, text_hash, n, end in zip(r["ids"].tolist(), r["hashes"].tolist(), r["sizes"].tolist(), ends.tolist(), strict=True):
                    spans.setdefault((doc, text_hash), []).append(r["spans"][end - n : end])
            unions = [union_of(x).astype(np.uint32).tobytes() for x in spans.values()]
            yield pa.record_batch([pa.array([d[0] for d in spans], pa.int64()), pa.array([d[1] for d in spans], pa.int64()), pa.array(unions, pa.binary())], names=["doc_id", "text_hash", "spans"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(1 << bits, "part").sortWithinPartitions("part")

    found = materialize(dealt(docs.mapInArrow(suffixes, RUN_ROWS)).mapInArrow(merge, RUN_ROWS), "suffix-merged")
    strings = dealt(found.where("kind = 'strings'")).mapInArrow(merge_strings, RUN_ROWS)
    return dealt(found.where("kind = 'covers'").union(strings)).mapInArrow(gather, _COVERS)


def union_of(spans: list[np.ndarray]) -> np.ndarray:
    """Maximal runs of what the spans (start, end, start, end, ...) cover, as rows of start and end."""
    pairs = np.concatenate(spans).reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    return np.stack([pairs[first, 0], reach[np.r_[first[1:] - 1, len(pairs) - 1]]], 1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of ``docs``.

    A null text counts as empty; a null ``doc_id`` comes after all others.  Rows that repeat as a
    whole (doc_id and text) are one document and get the same result; rows of one doc_id but
    different texts are ordered by a hash of the text.  ``kept``: the remaining bytes, which need not be
    UTF-8, since a repeat may end inside a character.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    covers = repeats(rows, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                spans = spans.as_py()
                gone = np.frombuffer(spans or b"", np.uint32).reshape(-1, 2).tolist()
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                for column, value in zip(columns, (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if with_kept else None), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_kept])

    both = rows.join(covers.hint("shuffle_hash"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    out = both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
