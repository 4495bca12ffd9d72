"""SimHash near-duplicates by the generalised pigeonhole principle (operator 10).

Fingerprints within ``radius`` bits are linked.  The 64 bits are grouped into partitions of
correlated bits; a dynamic program gives each partition its own threshold, the thresholds
summing to ``radius - partitions + 1``, so that the estimated number of candidates and probes is
least.  By the generalised pigeonhole principle two fingerprints within the radius agree, in some
partition, up to that partition's threshold.  A threshold t of a partition of w bits turns into
the C(w, t) masks that leave out t of its bits: within t bits means equal under some mask.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.components import connected_components
from payscope.llm.minhash import shingle_hashes as word_shingles
from payscope.llm.shared import materialize

SEED = 42
#: More hot buckets than this are joined by shuffle instead of broadcast.
MOST_BROADCAST_BUCKETS = 200_000
BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the text, repeats included (see the contract)."""
    words = (text or "").encode().translate(_LOWER).split()
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp: long) for every row of ``docs``: one pass, no shuffle.  A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_of(shingle_hashes(t.as_py(), width)) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each pair of bits is set in the same one.

    Counted over all rows; each task hands over 64 partial rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            x = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(x), 65536):
                bits = np.unpackbits(x[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        if n:
            yield pa.record_batch(
                [pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()), *(pa.array(total[:, j].astype(np.int64)) for j in range(BITS))],
                names=["bit", "n", *(f"c{j}" for j in range(BITS))],
            )

    schema = "bit int, n long, " + ", ".join(f"c{j} long" for j in range(BITS))
    sums = fps.select("fp").mapInArrow(run, schema).groupBy("bit").agg(F.sum("n").alias("n"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(BITS)))
    rows = sorted(sums.collect())  # 64 rows
    if not rows:
        return 0, np.zeros((BITS, BITS))
    return rows[0]["n"], np.array([r[2:] for r in rows], float)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy partitions of nearly equal size: each starts at the bit with the strongest remaining
    correlation and takes those that correlate most with what it has."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].max(initial=0), -b))]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        out.append(sorted(group))
        left -= set(group)
    return out


def allocate(n: int, together: np.ndarray, radius: int, verify_cost: float = 0.05) -> list[int]:
    """The masks of the cheapest plan.

    For 1 to radius + 2 partitions, a dynamic program over the partitions shares the thresholds
    (-1: not probed) that must sum to radius - partitions + 1.  The cost of a threshold is the rows
    it probes plus ``verify_cost`` for each estimated candidate pair; the estimate uses the share of
    ones of each bit over all fingerprints.
    """
    p = together.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[int]] = (math.inf, [])
    for parts in range(1, radius + 3):
        groups = group_bits(n, together, parts)
        total = radius - parts + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            chance = np.array([1.0])
            for b in group:
                chance = np.convolve(chance, [1 - differ[b], differ[b]])
            options = [(-1, 0.0)]
            for t in range(min(radius, len(group)) + 1):
                if math.comb(len(group), t) <= 2048:
                    options.append((t, n * math.comb(len(group), t) + verify_cost * n * n / 2 * chance[: t + 1].sum()))
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for t, more in options:
                    if cost + more < after.get(used + t, (math.inf,))[0]:
                        after[used + t] = (cost + more, [*chosen, t])
            table = after
        if total in table and table[total][0] < best[0]:
            masks = []
            for group, t in zip(groups, table[total][1], strict=True):
                if t >= 0:
                    masks += [sum(1 << b for b in group if b not in out) for out in itertools.combinations(group, t)]
            best = (table[total][0], masks)
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _block_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is connected within the block: every fingerprint is compared with those that no earlier
    one has reached, and linked to the nearest of those that reach it first; no pair is listed beyond such a spanning set."""
    left, links = np.unique(fps), []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            best, parent = np.full(len(left), BITS + 1, np.int64), np.zeros(len(left), np.uint64)
            for at in range(0, len(frontier), 256):
                own = frontier[at : at + 256]
                apart = np.bitwise_count(own[:, None] ^ left[None, :])
                least = apart.min(axis=0)
                closer = least < best
                best[closer], parent[closer] = least[closer], own[apart.argmin(axis=0)[closer]]
            near = best <= radius
            links += zip(parent[near].tolist(), left[near].tolist(), strict=True)
            frontier, left = left[near], left[~near]
    return links


def _units(rows: DataFrame, node: str, masks: list[int], block: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(node, fp, ``more``, unit) of ``rows``: each once for every mask, under what the mask leaves of its fingerprint.

    Buckets of more than ``block`` rows are cut into chunks by ``node``, and each pair of chunks is a unit of its own.
    """
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    keyed = rows.select(F.col(node).alias("node"), "fp", *more, F.explode(keys).alias("k")).select("node", "fp", *more, "k.mask", "k.key")
    # Only buckets of more than a chunk are cut; there are few, so the probes need not be shuffled to learn of them.
    hot = materialize(keyed.groupBy("mask", "key").count().where(F.col("count") > block), "simhash-hot")
    hint = F.broadcast if hot.count() <= MOST_BROADCAST_BUCKETS else lambda df: df
    chunks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int")
    return (
        keyed.join(hint(hot), ["mask", "key"], "left")
        .select("node", "fp", *more, "mask", "key", chunks.alias("chunks"), mine.alias("mine"))
        .select("node", "fp", *more, "mask", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("node", "fp", *more, F.xxhash64("mask", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"))
    )


def near_links(distinct: DataFrame, radius: int = 3, block: int = 1024) -> DataFrame:
    """Links (a, b: long) that connect exactly the fingerprints (column fp) within ``radius`` bits.

    Buckets of more than ``block`` fingerprints are cut into chunks, and each pair of chunks is a unit of its own, so no task takes a whole hot
    bucket; within a unit only a spanning set of links is written.  Nothing is capped: every pair of a bucket meets in some unit.
    """
    n, together = bit_statistics(distinct)
    masks = allocate(n, together, radius)
    if n < 2:
        return distinct.sparkSession.range(0).selectExpr("id AS a", "id AS b")
    units = _units(distinct, "fp", masks, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        held_u, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def settle(unit: np.ndarray, fps: np.ndarray) -> None:
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[starts, len(unit)])
            small = np.repeat(sizes <= 8, sizes)
            for d in range(1, 8):
                same = (unit[d:] == unit[:-d]) & small[d:]
                near = same & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= radius)
                links.extend(zip(fps[:-d][near].tolist(), fps[d:][near].tolist(), strict=True))
            for at, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                links.extend(_block_links(fps[at : at + size], radius))

        def flush() -> pa.RecordBatch:
            pairs = np.array(links, np.uint64).reshape(-1, 2)
            links.clear()
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            return pa.record_batch([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            unit = np.concatenate([held_u, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            settle(unit[:cut], fps[:cut])
            held_u, held_f = unit[cut:], fps[cut:]
            if len(links) > 200_000:
                yield flush()
        if len(held_u):
            settle(held_u, held_f)
        yield flush()

    # Units have at most two chunks, so equal units fit in memory; equal hashes of different units only add comparisons.
    return units.repartition("unit").sortWithinPartitions("unit").select("unit", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, component_text: long) for each row of ``docs``.

    The last two are the doc_id and the text's hash of the first row of its component, nulls after
    all others.  Exact copies share a fingerprint and are compared once.  A null or empty text has
    fingerprint zero and is linked like any other; rows that repeat get the same component.
    """
    each = materialize(fingerprints(docs, width), "simhash-fp")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = materialize(each.groupBy("fp").agg(F.min(row).alias("first")), "simhash-distinct")
    roots = materialize(connected_components(near_links(distinct.select("fp"), radius)), "simhash-roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_text"))
    return each.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "component_text")


#: Two signatures of 64 bits, of sets that share 0.8, differ in 6.4 bits on average; in more than 16 once in 30,000 times.
MOST_SIGNATURE_BITS = 16
_FACTORS = np.array([int(xxhash.xxh64_intdigest(b"%d" % k, SEED)) | 1 for k in range(BITS)], np.uint64)
#: Nodes and shingles of a chunk of a cluster: texts of two chunks are compared in one task.
CHUNK_NODES, CHUNK_SHINGLES = 512, 1_000_000
#: More nodes or rows than this are joined by shuffle instead of broadcast (16 bytes each).
MOST_BROADCAST_ROWS = 1_000_000


def weighted_fingerprint(words: Counter[bytes]) -> int:
    """The SimHash of a text's words, each weighing the root of its count: few words changed move few bits, however often common ones stand there."""
    if not words:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    weights = np.floor(1024 * np.sqrt(np.fromiter(words.values(), np.float64, len(words)))).astype(np.int64)  # whole numbers, so that ties are ties
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += weights[at : at + 8192] @ bits
    return int(np.packbits(2 * ones > weights.sum(), bitorder="little").view(np.uint64)[0])


def signature(shingles: np.ndarray) -> int:
    """A bit of each of 64 min-hashes of a set: two sets agree in a bit if they have the same least element, else by chance."""
    if not len(shingles):
        return 0
    least = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _FACTORS).min(axis=0), out=least)
    return int(np.packbits((least >> np.uint64(20)).astype(np.uint8) & 1, bitorder="little").view(np.uint64)[0])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node: hash of the text, fp of its words, sig and number of its shingles of ``width`` words) for every row: one pass, no shuffle.
    A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sigs, sizes = [], [], []
            for text in batch.column(2):
                fps.append(weighted_fingerprint(Counter((text.as_py() or "").encode().translate(_LOWER).split())))
                own = np.unique(shingle_hashes(text.as_py(), width))
                sigs.append(signature(own))
                sizes.append(len(own))
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sigs)] + [pa.array(sizes, pa.int64())]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["doc_id", "node", "fp", "sig", "shingles"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, fp long, sig long, shingles long")


def _near(fps: np.ndarray, sigs: np.ndarray, some: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """Which of ``others`` are candidates of which of ``some``, all by their places."""
    out = np.bitwise_count(fps[some, None] ^ fps[None, others]) <= radius
    a, b = np.nonzero(out)
    out[a, b] = np.bitwise_count(sigs[some[a]] ^ sigs[others[b]]) <= MOST_SIGNATURE_BITS
    return out


def _spanning(fps: np.ndarray, sigs: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of places that join what is joined by candidates: each is linked to the first that reaches it."""
    left = np.arange(len(fps))
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached, parent = np.zeros(len(left), bool), np.zeros(len(left), np.int64)
            for at in range(0, len(frontier), 256):
                near = _near(fps, sigs, frontier[at : at + 256], left, radius)
                new = near.any(axis=0) & ~reached
                parent[new] = frontier[at + near[:, new].argmax(axis=0)]
                reached |= new
            yield from zip(parent[reached].tolist(), left[reached].tolist(), strict=True)
            frontier, left = left[reached], left[~reached]


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one unit after the other (first column), which come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)] if len(unit) else []
        for low, high in itertools.pairwise(cuts):
            if held and held[0].column(0)[0].as_py() != unit[low]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.concat_batches(held)


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ordered = sorted({(min(p), max(p)) for p in pairs})
    return pa.record_batch([pa.array([p[i] for p in ordered], pa.int64()) for i in (0, 1)], names=["a", "b"])


def candidate_links(texts: DataFrame, radius: int, block: int, verify_cost: float) -> DataFrame:
    """Links (a, b: nodes) that join all ``texts`` (node, fp, sig) that are candidates: within the radius by their words, and near by their signatures.

    Of each unit of the plan a spanning set is written, so links grow with the texts, whatever the size of a group.
    """
    n, together = bit_statistics(texts)
    if n < 2:
        return texts.sparkSession.range(0).selectExpr("id AS a", "id AS b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for unit in _by_unit(batches):
            if len(unit) > 1:
                node, fps, sigs = (unit.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                links += ((node[i], node[j]) for i, j in _spanning(fps.view(np.uint64), sigs.view(np.uint64), radius))
            if len(links) > 200_000:
                yield _pairs_batch(links)
                links = []
        yield _pairs_batch(links)

    units = _units(texts, "node", allocate(n, together, radius, verify_cost), block, ("sig",))
    return units.repartition("unit").sortWithinPartitions("unit").select("unit", "node", "fp", "sig").mapInArrow(run, "a long, b long").distinct()


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast, if they are few."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST_ROWS else rows


def alike_links(clusters: DataFrame, texts: DataFrame, docs: DataFrame, likeness: float, width: int, radius: int) -> DataFrame:
    """Links (a, b) that join all texts of a cluster (node, root) of which two candidates share at least ``likeness`` of their shingles of
    ``width`` words, as sets; two texts without words are alike.

    A cluster is cut into chunks, and each pair of chunks is a task's unit that holds the shingles of its texts.  There every candidate pair is compared by
    the shingles themselves, unless links found before join it already; only links are written, no pairs.
    """
    members = materialize(clusters.join(texts.select("node", "fp", "sig", "shingles"), "node"), "simhash-members")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_NODES), F.ceil(F.sum("shingles") / CHUNK_SHINGLES))
    sizes = materialize(members.groupBy("root").agg(chunks.cast("int").alias("chunks")), "simhash-sizes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(_few(members.select("node")), "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(own.select("node", F.sort_array(F.array_distinct(word_shingles(F.col("text"), width))).alias("s")), "simhash-shingles")
    mine = F.pmod(F.xxhash64("node", F.lit(11)), F.col("chunks")).cast("int")
    units = (
        members.join(_few(sizes), "root").withColumn("mine", mine).join(sets, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "node", "fp", "sig", "mine", "s", (F.col("mine") == F.col("other")).alias("alone"))
    )

    def verified(unit: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        node, fps, sigs, chunk = (unit.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
        fps, sigs, lists, alone = fps.view(np.uint64), sigs.view(np.uint64), unit.column(5), unit.column(6)[0].as_py()
        sets = [lists[i].values.to_numpy() for i in range(len(node))]
        size, root = np.array([len(x) for x in sets]), np.arange(len(node))
        for i in range(len(node) - 1):
            later = np.arange(i + 1, len(node))
            ratio = np.minimum(size[i], size[later]) >= likeness * np.maximum(size[i], size[later])
            later = later[ratio & (root[later] != root[i]) & (alone | (chunk[later] != chunk[i]))]
            for j in later[_near(fps, sigs, np.array([i]), later, radius)[0]].tolist():
                if root[i] != root[j]:
                    x, y = (sets[i], sets[j]) if size[i] >= size[j] else (sets[j], sets[i])
                    shared = int((x[np.minimum(x.searchsorted(y), len(x) - 1)] == y).sum()) if len(y) else 0
                    if shared >= likeness * (len(x) + len(y) - shared):
                        root[root == root[j]] = root[i]
                        yield node[i], node[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for unit in _by_unit(batches):
            if len(unit) > 1:
                links += verified(unit)
        yield _pairs_batch(links)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def alike_texts(docs: DataFrame, likeness: float, width: int, radius: int, block: int = 8192, verify_cost: float = 0.0005) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node; texts: node, fp, root, first) of ``docs``: the different texts with the root of their component, a link being a pair of texts
    that share at least ``likeness`` of their ``width``-word shingles, and the first row of each component by doc_id.

    Candidates are texts whose SimHashes are within ``radius`` bits and whose signatures are near.  What candidates join is a cluster, and within
    clusters every candidate pair is checked, or its texts are joined already.
    """
    rows = materialize(signatures(docs, width), "simhash-rows")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    texts = rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("fp", "sig", "shingles")), F.min(row).alias("first"))
    texts = materialize(texts, "simhash-texts")
    clusters = materialize(connected_components(candidate_links(texts, radius, block, verify_cost)), "simhash-clusters")
    roots = materialize(connected_components(alike_links(clusters, texts, docs, likeness, width, radius)), "simhash-roots")
    rooted = texts.join(roots, "node", "left").select("node", "fp", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rows.select("doc_id", "node"), materialize(rooted.drop("first").join(least, "root"), "simhash-rooted")


def alike_duplicates(docs: DataFrame, likeness: float = 0.8, width: int = 5, radius: int = 8) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, component_text: long) for each row of ``docs``, as ``near_duplicates`` has them, where a
    link is a pair of texts that share at least ``likeness`` of their ``width``-word shingles (see ``alike_texts``)."""
    rows, texts = alike_texts(docs, likeness, width, radius)
    named = texts.select("node", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.node").alias("component_text"))
    return rows.join(named, "node").select("doc_id", F.col("node").alias("text_hash"), "fp", "component_id", "component_text")


def without_near_duplicates(docs: DataFrame, likeness: float = 0.8, width: int = 5, radius: int = 8) -> DataFrame:
    """The first row of each component of ``alike_duplicates`` by doc_id (nulls last), then by the text's hash; its columns as
    they are.  Of rows that repeat one stays; a null text is like an empty one.

    Keys are decided on, and the rows themselves are only filtered: by a broadcast of the keys that go, or by one shuffle where those are many.
    """
    rows, texts = alike_texts(docs, likeness, width, radius)
    key = F.xxhash64("doc_id", "node").alias("_key")
    stay = texts.select(F.col("first.doc_id").alias("doc_id"), F.col("first.node").alias("node")).distinct().select(key, "node")
    counted = materialize(rows.select(key, "node").groupBy("_key", "node").count(), "simhash-keys")
    gone = materialize(counted.join(stay, ["_key", "node"], "left_anti").select("_key", F.col("node").alias("_node")), "simhash-gone")
    twice = materialize(counted.where("count > 1").join(stay, ["_key", "node"], "left_semi").select("_key", F.col("node").alias("_node")), "simhash-twice")
    node = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumn("_node", node).withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), "_node"))
    kept = keyed.join(_few(gone), ["_key", "_node"], "left_anti")
    if not twice.isEmpty():
        once = kept.join(_few(twice), ["_key", "_node"], "left_anti")
        kept = once.union(kept.join(_few(twice), ["_key", "_node"], "left_semi").dropDuplicates(["_key", "_node"]).select(once.columns))
    return kept.select(docs.columns)


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
