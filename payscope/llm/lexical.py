"""Ranked lexical search by block-max pruning (operator 12).

The index is a table of blocks: each holds a range of documents in the order in which they lie in the table, a forward index of their terms, and
for each term the largest part that it adds to a score there, before its weight.  The sum of weights times maxima is
a query's bound in the block: no document of it scores more.  Blocks are taken in descending order of that bound, and those under the
query's threshold, the score of the tenth best so far, are not scored.

The blocks of the greatest bounds in the whole index are scored first, which gives each query a threshold that holds in all tasks.  With it
every task begins, and goes on raising it by what it finds in its own blocks.  Nothing is left out but documents whose bound
is under ten scores that were found.
"""

from __future__ import annotations

import contextlib
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.llm.shared import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a block.
BLOCK = 64
#: Blocks that are scored first for each query, those of the greatest bounds in the whole index.
SEEDS = 4
#: Queries are searched in batches with at most so many terms in all (repeats included): what a task holds of them is bounded.
BATCH_TERMS = 500_000
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included: runs of ASCII digits, letters in lower case and all that isn't ASCII."""
    return (text or "").encode().translate(_TABLE).split()


#: Texts, and blocks, that pass between Spark and a task at a time: what both hold does not grow with the table.
TEXTS, BLOCKS = 500, 16
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _at_a_time(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that begin within pass so many rows to a task at a time."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


_BLOCKS = "block string, n array<long>, doc_id array<long>, doc array<int>, term array<int>, tf array<long>, total long, filled long"


def _forward(number: dict[bytes, int], block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of documents with the postings of the numbered terms, sorted by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held_id: list[int | None] = []
        held_n: list[int] = []
        postings: list[np.ndarray] = []
        blocks = 0

        def flush() -> pa.RecordBatch:
            nonlocal blocks
            found = np.concatenate(postings)
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            name = f"{TaskContext.get().partitionId()}-{blocks}"
            row = [[name], [held_n], [held_id], [found[:, 1]], [found[:, 0]], [found[:, 2]], [sum(held_n)], [sum(n > 0 for n in held_n)]]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            out = pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["block", "n", "doc_id", "doc", "term", "tf", "total", "filled"])
            blocks += 1
            for held in (held_id, held_n, postings):
                held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                counts = Counter(words)
                postings.append(np.array([(number[t], len(held_id), counts[t]) for t in counts.keys() & number.keys()], np.int64).reshape(-1, 3))
                held_id.append(doc_id)
                held_n.append(len(words))
                if len(held_id) == block:
                    yield flush()
        if held_id:
            yield flush()

    return run


def _with_maxima(filled: int, total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with the part of each posting in a score, before its weight, and the greatest part of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {k: _lists(batch.column(k)) for k in ("n", "doc", "term", "tf")}
            for i in range(len(batch)):  # one block at a time, its postings as arrays
                m = np.array([10 + (90 * k * filled) // total if total else 10 for k in flat["n"](i).to_pylist()], np.int64)  # Python's whole numbers don't overflow
                doc, t, tf = (flat[k](i).to_numpy() for k in ("doc", "term", "tf"))
                part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]) if len(t) else np.zeros(0, np.int64)
                at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
                most = np.maximum.reduceat(part, at) if len(at) else part
                made = [pa.array([part], pa.list_(pa.int64())), pa.array([t[at]], pa.list_(pa.int32())), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([most], pa.list_(pa.int64()))]
                same = [batch.column(k).slice(i, 1) for k in ("block", "doc_id", "doc")]
                yield pa.record_batch([*same, *made], names=["block", "doc_id", "doc", "part", "terms", "starts", "most"])

    return run


_INDEX = "block string, doc_id array<long>, doc array<int>, part array<long>, terms array<int>, starts array<int>, most array<long>"


class _Queries:
    """Terms and weights of the queries of a batch, behind one another, and the queries of each term."""

    def __init__(self, queries: list[list[tuple[int, int]]], size: int) -> None:
        self.count = len(queries)
        self.terms = np.array([t for q in queries for t, _ in q], np.int64)
        self.weights = np.array([w for q in queries for _, w in q], np.int64)
        self.starts = np.cumsum([0, *map(len, queries)])
        self.size = size

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The bound of each query in a block.  Sums of whole numbers below 2^63: a part is at most 10^6."""
        dense = np.zeros(self.size, np.int64)
        dense[terms] = most
        sums = np.r_[0, np.cumsum(self.weights * dense[self.terms])]
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def scores(self, q: int, terms: np.ndarray, ends: np.ndarray, doc: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """The scores of the documents of a block for query ``q``; the postings of ``terms[i]`` stand from ``ends[i]`` to ``ends[i + 1]``."""
        low, high = self.starts[q], self.starts[q + 1]
        at = np.searchsorted(terms, self.terms[low:high])
        here = terms[np.minimum(at, len(terms) - 1)] == self.terms[low:high]
        at, weights = at[here], self.weights[low:high][here]
        first, sizes = ends[at], ends[at + 1] - ends[at]
        each = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        out = np.zeros(docs, np.int64)
        np.add.at(out, doc[each], np.repeat(weights, sizes) * part[each])
        return out


_FOUND = "query int, score long, doc_id long, block string, doc int"
#: A task looks at so many blocks at a time that they have about this many bounds.
CELLS = 4_000_000


def _blocks_of(batches: Iterator[pa.RecordBatch], queries: _Queries) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Groups of blocks in which a query has a bound above zero, packed, with their bounds (blocks x queries)."""
    blocks, bounds = [], []
    for batch in batches:
        flat = {name: _lists(batch.column(name)) for name in ("doc_id", "doc", "part", "terms", "starts", "most")}
        for i, name in enumerate(batch.column("block").to_pylist()):
            ids, doc, part, terms, starts, most = (flat[c](i) for c in ("doc_id", "doc", "part", "terms", "starts", "most"))
            here = queries.bounds(terms.to_numpy(), most.to_numpy())
            if (here > 0).any():
                blocks.append((name, ids.to_pylist(), doc.to_numpy().copy(), part.to_numpy().astype(np.int32), terms.to_numpy().copy(), starts.to_numpy().copy()))
                bounds.append(here)
            if len(blocks) * queries.count >= CELLS:
                yield blocks, np.array(bounds)
                blocks, bounds = [], []
    if blocks:
        yield blocks, np.array(bounds)


def _promising(queries: _Queries, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``most`` blocks of the greatest bounds for each query among those of a task: (query, bound as score, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, bounds in _blocks_of(batches, queries):
            rows = []
            for q in range(queries.count):
                for b in np.argsort(-bounds[:, q], kind="stable")[:most].tolist():
                    if bounds[b, q] > 0:
                        rows.append((q, int(bounds[b, q]), None, blocks[b][0], None))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["query", "score", "doc_id", "block", "doc"])

    return run


def _search(queries: _Queries, thresholds: list[int], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ``k`` best documents of each query among the blocks of a task, taken in descending order of their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in range(queries.count)]
        for blocks, bounds in _blocks_of(batches, queries):
            ends = [np.r_[b[5], len(b[2])].astype(np.int64) for b in blocks]
            for q, heap in enumerate(heaps):
                for b in np.argsort(-bounds[:, q], kind="stable").tolist():
                    least = max(1, thresholds[q], heap[0][0][0] if len(heap) == k else 0)
                    if bounds[b, q] < least:
                        break
                    name, ids, doc, part, terms, _ = blocks[b]
                    scores = queries.scores(q, terms, ends[b], doc, part, len(ids))
                    for d in np.flatnonzero(scores >= least).tolist():
                        # Greater is better: by score, then by smaller doc_id, null last.
                        entry = ((int(scores[d]), ids[d] is not None, -(ids[d] or 0)), name, d)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        rows = [(q, key[0], -key[2] if key[1] else None, name, d) for q, heap in enumerate(heaps) for key, name, d in heap]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["query", "score", "doc_id", "block", "doc"])

    return run


def _lists(column: pa.ListArray) -> Callable[[int], pa.Array]:
    """Row i of a column of lists as an array, without a copy."""
    values, offsets = column.values, column.offsets.to_pylist()
    return lambda i: values.slice(offsets[i], offsets[i + 1] - offsets[i])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ranked: first among the rows of equal block hashes, so that no query's rows all meet before they are few."""
    order = "ORDER BY score DESC, doc_id ASC NULLS LAST, block, doc"
    some = found.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY query, pmod(xxhash64(block), 64) {order})")).where(F.col("_r") <= k)
    return some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY query {order})")).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score", "block")


def _batches(items: DataFrame, most_terms: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their distinct terms, in batches of at most ``most_terms`` terms or one item; items without terms are left out."""
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    for item_id, text in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        terms = sorted(set(terms_of(text)))
        if held and size + len(terms) > most_terms:
            yield held
            held, size = [], 0
        if terms:
            held.append((item_id, terms))
            size += len(terms)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: (item_id, rank: int, doc_id: long, score: long).

    ``docs`` (doc_id, text) and ``items`` (item_id, text) may have other columns.  Equal scores are ranked by ascending doc_id, nulls last.  Items without terms, and items none of
    whose terms is in a document, have no rows; nor have null or empty texts.  Rows that repeat are documents, and items, of their own.  A very
    long text is one row of its block.  Items are read in batches of bounded terms, so the driver and the tasks hold one
    batch; the index holds the terms of the batch, as no others can add to a score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out: DataFrame | None = None
    for batch in _batches(items, batch_terms):
        number = {t: i for i, t in enumerate(sorted({t for _, terms in batch for t in terms}))}
        with _at_a_time(spark, TEXTS):
            forward = materialize(rows.mapInArrow(_forward(number, block), _BLOCKS), "lexical-forward")
        filled, total = forward.agg(F.sum("filled"), F.sum("total")).first()
        if not filled:
            continue
        counted = forward.select(F.explode("term").alias("term")).groupBy("term").count()
        frequency = dict(counted.collect())  # at most the terms of the batch
        weight = {t: math.floor(1000 * math.log((2 * filled + 2) / (2 * df + 1))) for t, df in frequency.items()}
        queries = _Queries([[(number[t], w) for t in terms if (w := weight.get(number[t], 0)) > 0] for _, terms in batch], len(number))
        with _at_a_time(spark, BLOCKS):
            index = materialize(forward.mapInArrow(_with_maxima(filled, total), _INDEX), "lexical-index")
            # SEEDS blocks for each item of the batch: what reaches the driver and what is broadcast are bounded by the batch.
            seeds = {r["block"] for r in _best(index.mapInArrow(_promising(queries, SEEDS), _FOUND), SEEDS).select("block").distinct().collect()}
            named = F.broadcast(spark.createDataFrame([(b,) for b in sorted(seeds)], "block string"))
            first = _best(index.join(named, "block", "left_semi").mapInArrow(_search(queries, [0] * len(batch), k), _FOUND), k)
            tenth = dict(first.where(F.col("rank") == k).select("query", "score").collect())
            found = _best(index.mapInArrow(_search(queries, [tenth.get(q, 0) for q in range(len(batch))], k), _FOUND), k)
            names = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(batch)], f"query int, item_id {kind}")
            ranked = materialize(found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-found")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


#: DuckDB SQL for the query: every term of every document that an item holds, without an index.
SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tokens AS (SELECT doc_id, n, unnest(terms) AS term FROM sized),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
parts AS (
  SELECT doc_id, term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))) AS part
  FROM tf JOIN df USING (term), corpus),
scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
