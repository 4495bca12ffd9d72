"""Near duplicates, repeated strings and fingerprints against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from payscope.llm import minhash, simhash, suffix_dedup
from payscope.llm.components import connected_components
from payscope.llm.queries import op1_document_fingerprints, op10_simhash_dedup
from payscope.llm.sorted_runs import front_coded, merged, sorted_order, unpack

SF = "/root/testdata/sf0.001"


def brute_removed(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def mixed_docs(seed, n=90):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randint(0, 700))) for _ in range(20)]
    docs = []
    for i in range(n):
        s, k = rng.choice(base), rng.random()
        if k < 0.3:
            t = "".join(rng.choice("xyzw") for _ in range(rng.randint(0, 300)))
        elif k < 0.6:
            t = s[rng.randint(0, len(s)) :] + rng.choice(base)[: rng.randint(0, 300)] + rng.choice(base)
        elif k < 0.7:
            t = "a" * rng.randint(0, 300) + "ab" * rng.randint(0, 200) + "\0" * rng.randint(0, 150)
        elif k < 0.9:
            t = "".join("Q" if rng.random() < 0.01 else c for c in s)
        else:
            t = s
        docs.append((i, t))
    rng.shuffle(docs)
    return [*docs, (500, None), (501, "")]


@pytest.mark.parametrize("length, hot, block", [(100, 8192, 5000), (100, 3, 5000), (32, 2, 2000), (32, 8192, 1 << 20)])
def test_remove_repeats(spark, monkeypatch, length, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    docs = mixed_docs(length + hot)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash")).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(df, length).collect()}
    assert got == brute_removed(docs, length)


def test_remove_repeats_from_the_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == brute_removed(docs, 100)


def test_rows_that_repeat_are_one_document(spark):
    rows = [(1, "x" * 50 + "y" * 80), (1, "x" * 50 + "y" * 80), (None, "x" * 50 + "y" * 80), (None, None)]
    got = sorted(((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(False, 130, 0), (False, 130, 0), (True, 0, 0), (True, 130, 130)]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert minhash.edited_fingerprints(empty).count() == 0


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "é" * 60), (2, "é" * 60 + "z")], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df, with_kept=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {i: v[1] for i, v in brute_removed([(1, "é" * 60), (2, "é" * 60 + "z")], 100).items()}
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in rows)


@pytest.mark.parametrize("n_runs", [1, 2, 5, 8])
def test_loser_tree(n_runs):
    import numpy as np

    rng = np.random.default_rng(n_runs)
    runs, everything = [], []
    for _ in range(n_runs):
        rows = rng.integers(0, 3, (rng.integers(0, 40), 12)).astype(np.uint8)
        rows = np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], axis=1)
        rows = np.unique(rows, axis=0)
        rows = rows[sorted_order(rows)]
        everything += [r.tobytes() for r in rows]
        runs.append(unpack(front_coded(rows)))
    out = list(merged(runs, 13))
    assert [key for key, *_ in out] == sorted(everything)
    for (a, *_), (b, shared, *_) in zip(out, out[1:], strict=False):
        assert shared == next((k for k in range(13) if a[k] != b[k]), 13)


def words_of(text):
    raw = (text or "").encode()
    return bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()


def brute_fingerprint(text, width=3):
    words = words_of(text)
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_dedup(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op10_simhash_dedup(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("block", [4, 1024])
def test_links_in_chunks(spark, block):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, 7, 15, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, block)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = brute_components({f: f & (1 << 64) - 1 for f in signed})
    groups = lambda m: {frozenset(i for i in signed if m.get(i, i) == r) for r in {m.get(i, i) for i in signed}}
    assert groups(roots) == groups(want)


def test_components_of_a_chain(spark):
    """Ascending labels, each linked only to the next, beside a star: no number of rounds is assumed."""
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(roots) == 301 + 200 and len({roots[k] for k in range(301)}) == 1 and len({roots[1000 + k] for k in range(200)}) == 1
    assert roots[0] != roots[1000]


def test_near_duplicate_rows(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(5, long, "a"), (3, long + " end", "b"), (3, long + " end", "b"), (None, "other text entirely", "c"), (7, None, "d"), (8, "", "e"), (9, "one two", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["root"]) for r in kept.collect()) == [("3", "b"), ("7", "d"), ("9", "f"), ("None", "c")]


def brute_words(text):
    """Each bit by the words that have it, a word weighing 1024 times the root of its count, rounded down."""
    counts = Counter((text or "").encode().lower().split())
    weights = {xxhash.xxh64_intdigest(w, 42): math.floor(1024 * math.sqrt(n)) for w, n in counts.items()}
    total = sum(weights.values())
    return sum(1 << b for b in range(64) if 2 * sum(x for h, x in weights.items() if h >> b & 1) > total)


def brute_alike(texts, radius=8, likeness=0.8):
    """Components of the texts that are near by the SimHashes of their words and share enough five-word shingles."""
    fps = {i: brute_words(t) for i, t in texts.items()}
    cut = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = {i: cut((t or "").lower().split()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius and len(sets[a] & sets[b]) >= likeness * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_alike_duplicates(spark):
    """The documents with edited copies of every degree: links at 0.8 and above only, and most of those are found."""
    rng = random.Random(21)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    long = [t.split() for t in texts.values() if t and len(t.split()) > 60]
    for k in range(150):
        own = list(rng.choice(long))
        for _ in range(max(1, int(len(own) * rng.choice([0.002, 0.01, 0.02, 0.06])))):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts[10_000 + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"fp": F.lit("x"), "rep": F.lit("y")})
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike_duplicates(df).collect()}
    assert got == brute_alike(texts)
    whole = brute_alike(texts, radius=64)
    linked = [i for i in texts if whole[i] != i]
    assert len(linked) > 60 and sum(got[i] != i for i in linked) >= 0.95 * len(linked)


@pytest.mark.parametrize("each", [8, 512])
def test_dense_groups_lose_no_link(spark, monkeypatch, each):
    """Groups of texts that are all near by their words, of which some share their shingles and others are made of the same words in another order."""
    monkeypatch.setattr(simhash, "CHUNK_NODES", each)
    rng, texts = random.Random(each), {}
    for group in range(3):
        words = [f"g{group}w{k}" for k in range(60)] + ["the"] * 20
        chunks = [words[k : k + 20] for k in range(0, 80, 20)]
        for k in range(40):
            own = list(chunks)
            rng.shuffle(own)
            own = [w for c in own for w in c]
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts[100 * group + k] = " ".join(own)
        for k in range(10):  # the words shuffled one by one: near, but not alike
            own = list(words)
            rng.shuffle(own)
            texts[100 * group + 50 + k] = " ".join(own)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(i + 1000, t) for i, t in texts.items()], "doc_id long, text string")
    rows, found = simhash.alike_texts(df, 0.8, 5, 8, block=32)
    first = {r["node"]: r["first"]["doc_id"] for r in found.collect()}
    got = {r["doc_id"]: first[r["node"]] for r in rows.collect()}
    want = brute_alike(texts)
    assert {i: got[i] for i in texts} == want and {i: got[i + 1000] for i in texts} == want
    assert 3 < len(set(want.values())) < len(texts)
    assert sorted(r["doc_id"] for r in simhash.without_near_duplicates(df).collect()) == sorted(set(want.values()))


def test_recall_of_pairs(spark):
    """Of the pairs of different texts of sf0.1 that share 0.8 of their shingles, counted exactly, at least 0.95 are within the stage's radius."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL").select("text").distinct().collect()]
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    often = Counter(x for s in sets for x in s)
    under, pairs = {}, []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        # Two sets that share 0.8 share one of the rarest fifth of either.
        prefix = sorted(sets[i], key=lambda x: (often[x], x))[: len(sets[i]) - math.ceil(0.8 * len(sets[i])) + 1]
        near = {j for x in prefix for j in under.get(x, ())}
        pairs += [(i, j) for j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        for x in prefix:
            under.setdefault(x, []).append(i)
    fp = {i: simhash.weighted_fingerprint(Counter(texts[i].encode().lower().split())) for i in {i for pair in pairs for i in pair}}
    sig = {i: simhash.signature(np.array(sorted(sets[i]), np.uint64)) for i in fp}
    within = sum((fp[i] ^ fp[j]).bit_count() <= 8 and (sig[i] ^ sig[j]).bit_count() <= simhash.MOST_SIGNATURE_BITS for i, j in pairs)
    assert len(pairs) >= 40 and within >= 0.95 * len(pairs)


def test_fingerprints(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in op1_document_fingerprints(spark, SF).collect()}
    assert set(got) == set(docs)

    def jaccard(a, b):
        cut = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
        x, y = cut(a), cut(b)
        return len(x & y) / max(1, len(x | y))

    errors = []
    for k, i in enumerate(order):
        text, following = docs[i], docs[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if len(text.split()) >= 10 and len(edited.split()) >= 10:
            errors.append(abs(r["near_edited"] - jaccard(text, edited)))
            assert 0 <= r["near_next"] <= 1
    by_text = {}
    for i, t in docs.items():
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.25


def test_very_long_texts_and_clashing_columns(spark):
    """One text of a megabyte beside its copy with a changed end, with columns called like those of the results."""
    long = " ".join(f"w{k % 7919}" for k in range(170_000))
    rows = [(1, long), (2, long[:-9] + "something"), (3, "short"), (None, None)]
    names = "fp root fingerprint component_id text_hash sketch bucket next_text n_bytes kept_sha256 guest edited head spans".split()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in names})
    one = {r["doc_id"]: r for r in minhash.edited_fingerprints(df).collect()}
    assert set(one) == {1, 2, 3, None} and one[1]["n_chars"] == len(long)
    assert one[2]["near_next"] > 0.95 and one[1]["near_next"] == 0 == one[3]["near_next"]  # by descending id; nulls come last
    two = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert two[2] == (len(long), len(long) - 9, 1) and two[3] == (5, 0, 0) and two[None] == (0, 0, 0)
    ten = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert ten == {1: 1, 2: 1, 3: 3, None: None}
    assert simhash.without_near_duplicates(df).columns == df.columns and simhash.without_near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_edges(spark):
    rows = [(1, ""), (2, None), (3, "one"), (4, "ONE"), (4, "ONE"), (None, "a b c d e f g")]
    got = minhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[1] == by[2] == "" and by[3] == by[4] != ""


@pytest.mark.parametrize("per_bucket", [1, 7, 1000])
def test_next_row_over_many_buckets(spark, per_bucket):
    rng = random.Random(per_bucket)
    rows = [(i * i % 997 * 1000, f"t{i}") for i in rng.sample(range(400), 90)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    rows = [*dict(rows).items(), (None, "none")]
    got = {r["text"]: (r["next_text"], r["next_sketch"], r["sketch"]) for r in minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_bucket, 50).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    assert len(got) == len(rows)
    for k, t in enumerate(order):
        following = order[(k + 1) % len(order)]
        assert got[t][0] == following and got[t][1] == got[following][2]
