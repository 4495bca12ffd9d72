"""Encoding, search and spelling variants against a public library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from payscope.llm import bpe, lexical, spelling
from payscope.llm.queries import op11_bpe_encoding

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def odd_text(rng, most):
    parts = ["a", "b", "e", "th", "ing", " ", "'s", "é", "Σ", "ß", "1", "!?", "<|endoftext|>", "“", "中文", "́", "\U0001f600", "İ", "՘", "the", "HAHA", "\x85", "\x1c", "'", "\n", "Ƛ"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(most)))


def test_encoder_is_the_library(vocabulary, library):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(5)
    for _ in range(4000):
        text = odd_text(rng, 30)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_halves_join_to_the_whole(vocabulary):
    encoder, rng = bpe.Encoder(vocabulary), random.Random(6)
    for _ in range(1500):
        data = "".join(rng.choice(["a", "b", "n", "an", "ha", "in", "th", "e", "er", "o", "é", "ing", "tion"]) for _ in range(rng.randrange(2, 150))).encode()
        cut = rng.randrange(1, len(data))
        assert encoder.joined(encoder.leaf(data[:cut], False), encoder.leaf(data[cut:], True)) == encoder.leaf(data, True)


@pytest.mark.parametrize("leaf", [1, 7, bpe.LEAF])
def test_encode_texts(spark, vocabulary, library, leaf):
    rng = random.Random(leaf)
    texts = [odd_text(rng, 60) for _ in range(40)] + ["", None, "same", "same", "ha" * 5000, "x" * 40_000 + "<|startoftext|>" + "word " * 3000, " \n\t", "1" * 9000]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "row": F.lit(1)}).repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.n_tokens, r.decoded) for r in bpe.decode_ids(bpe.encode_texts(docs, vocabulary, leaf), vocabulary).collect()))
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id is None, doc_id or 0, np.array(ids, "<u4").tobytes(), len(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_encoding_of_an_empty_table(spark, vocabulary):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []


def test_improper_vocabulary_is_refused(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"] = [*spec["model"]["merges"], spec["model"]["merges"][0]]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))


def test_encoding_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_bpe_encoding(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert got[doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(_LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, counts), size in zip(held, sizes, strict=True):
            score = 0
            for t in set(terms(text)):
                if t in counts:
                    m = 10 + 90 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r + 1, None if none else doc_id, -s) for r, (s, none, doc_id) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, batch_terms, cells", [(64, 500_000, 4_000_000), (3, 12, 1), (1, 1, 50)])
def test_search(spark, monkeypatch, block, batch_terms, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "SEEDS", 1)
    rng = random.Random(block)
    words = ["alpha", "Beta", "gamma", "été", "x1", "中文", "delta", "rare", "omega-z", "I", "İ"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randrange(n)))
    docs = [(i, text(40)) for i in range(120)] + [(7, "alpha alpha"), (7, "alpha alpha"), (None, "rare gamma"), (500, None), (501, ""), (502, "..."), (503, "alpha " * 20_000), (504, "beta"), (505, "beta")]
    rng.shuffle(docs)
    items = [(i, text(6)) for i in range(4)] + [(9, "alpha Alpha BETA"), (10, "rare"), (11, None), (12, "none of it"), (13, ""), (14, "été 中文"), (10, "rare")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "block": F.lit(1)}).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted((tuple(r) for r in lexical.search(d, i, 10, block, batch_terms).collect()), key=repr)
    assert got == brute_search(docs, items, 10)


def test_blocks_are_scored_one_at_a_time(spark):
    texts = pa.record_batch([pa.array([1, 2, 3, 4, 5]), pa.array(["a b a", "b", None, "x", "a a a b"])], names=["doc_id", "text"])
    docs = spark.createDataFrame(texts.to_pylist(), "doc_id long, text string").coalesce(1)
    forward = docs.mapInArrow(lexical._forward({b"a": 0, b"b": 1}, 2), lexical._BLOCKS).toArrow().combine_chunks().to_batches()
    made = list(lexical._with_maxima(4, 9)(iter(forward)))
    assert [len(b) for b in made] == [1, 1, 1]
    m = [10 + 90 * n * 4 // 9 for n in (3, 1, 0, 1, 4)]
    part = lambda tf, d: 1_000_000_000 * tf // (1000 * tf + 8 * m[d])
    assert made[0].to_pylist()[0] == {"block": "0-0", "doc_id": [1, 2], "doc": [0, 0, 1], "part": [part(2, 0), part(1, 0), part(1, 1)], "terms": [0, 1], "starts": [0, 1], "most": [part(2, 0), max(part(1, 0), part(1, 1))]}
    assert [b.to_pylist()[0]["part"] for b in made[1:]] == [[], [part(3, 4), part(1, 4)]]


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "word")], "item_id int, text string")
    assert lexical.search(none, one).collect() == []
    assert lexical.search(one.withColumnRenamed("item_id", "doc_id"), one.limit(0)).collect() == []


def brute_spelling(docs):
    n = Counter()
    for doc_id, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    n = Counter({w: c for w, c in n.items() if len(w) >= 5 and c >= 3})
    letters = {c for w in n for c in w}
    form, count = {}, {}
    for w in n:
        changed = {w[:i] + x + w[i + j :] for i in range(len(w) + 1) for x in ["", *letters] for j in (0, 1)} - {w}
        found = [x for x in changed if x in n and abs(len(x) - len(w)) <= 1]
        count[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted((w, form[w] or "", root[w], n[w], count[w], n[form[w]] if form[w] else None) for w in n)


@pytest.mark.parametrize("meet", [2048, 2])
def test_spelling_variants(spark, monkeypatch, meet):
    monkeypatch.setattr(spelling, "MEET", meet)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rng = random.Random(meet)
    words = ["kitten", "kittens", "mitten", "sitten", "kittén", "abcde", "abced", "edcba", "aabbcc", "aabbc", "bcdea", "ÿÀ×÷öäü", "short", "sho", "l" * 300, "l" * 301, "ab" * 150, "ba" * 150]
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(40))) for i in range(60)]
    docs += [(None, "kitten Kitten KITTEN"), (3, None), (4, ""), (5, "chainaaaa " * 3 + "chainaaab " * 6 + "chainaabb " * 12 + "chainabbb " * 24 + "chainbbbb " * 48), (5, "tied1tiedab tiedac tiedad"), (6, "tiedab tiedac tiedad tiedab tiedac tiedad")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1)}).repartition(3)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in spelling.group_spellings(rows).collect())
    assert got == brute_spelling(docs)
    assert ("chainaaaa", "chainaaab", "chainbbbb", 3, 1, 6) in got


def test_spelling_of_an_empty_table(spark):
    assert spelling.group_spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_remainders_and_near():
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        for letter in set(word):
            found = dict(spelling._remainders(word, letter))
            assert set(found) == {i for i, c in enumerate(word) if c == letter}
            for i, h in found.items():
                assert h == dict(spelling._remainders(word[:i] + word[i + 1 :], ""))[-1]
        other = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        lost = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
        swapped = {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in "abc"} - {word}
        assert spelling.near(word, other) == (other in swapped or other in lost(word) or word in lost(other))
