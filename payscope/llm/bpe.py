"""Byte-pair encoding of whole texts by tree concatenation, and decoding (operator 11).

A vocabulary is proper if each merge makes a token of its own out of tokens that are there before it.  Then merges run in the
order of their ranks, a token has one derivation, and a sequence of tokens is the encoding of its symbols exactly
if each pair of neighbours is the encoding of its own: the first merge across a border would be made in the pair alone as well.
So a part of an encoding is the encoding of that part, and two encoded halves may be joined by encoding only
a window around the join: it starts with a token of either side and grows until its outermost tokens are the sides' own,
which makes every pair of neighbours one that is known from an encoding.  A window that reaches the end of a side agrees with it.

Words (what the pattern of the vocabulary leaves unsplit) of up to ``leaf`` bytes are encoded at once, in one pass over the rows.
Rows with a longer run are cut: their words in bundles and the leaves of long words become rows of their own, are encoded by all
tasks, and join in a binary tree, a shuffle of the long words for each of its levels.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import materialize, rows_of

#: Longest word, in bytes, that is encoded at once.
LEAF = 4096
#: Words, and runs without white space, of at most this many characters are remembered by a worker, this many of either.
REMEMBERED_LETTERS, REMEMBERED_TEXTS = 64, 150_000
_ID_BITS = 24
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Characters whose properties are the same in all versions of Unicode that the installed libraries know.
_SETTLED = regex.compile(r"[\x00-\u0557\u2000-\u206f]*")

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as this machine's unsigned integers, which must be little-endian and of 32 bits")
_remembered: dict[int, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def _remember(known: dict[str, bytes], text: str, packed: bytes) -> None:
    if len(text) <= REMEMBERED_LETTERS:
        if len(known) >= REMEMBERED_TEXTS:
            known.clear()
        known[text] = packed


class Vocabulary:
    """What encoding needs of a tokenizer file: merges, symbols of bytes, added tokens and the pattern of words.

    Files with NFC, white space and lower case as normalizers, one pattern of words, byte-level symbols and an
    ending of words are read; others, and vocabularies that aren't proper, are refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in before] != ["Split", "ByteLevel"] or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a vocabulary of words with an ending over normalised lower-case text")
        ids, ending = model["vocab"], model["end_of_word_suffix"]
        self.tokens: list[str] = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in [*ids.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + ending] for c in letters]
        #: The rank of a pair and what it makes, as one number that is ordered by rank.
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        known = {*self.inner, *self.final}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            made = ids[a + b]
            if ids[a] not in known or ids[b] not in known or made in known:
                raise ValueError(f"{path}: merge {rank} has no parts before it or makes a token that is there already")
            known.add(made)
            self.merges[ids[a], ids[b]] = rank << _ID_BITS | made
            self.parts[made] = (ids[a], ids[b])
        self.pattern = before[0]["pattern"]["Regex"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The file without its tokens, for the library's normalizer and pattern.
        self.rules = json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []})
        self.key = hash((self.rules, tuple(self.merges)))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints in Latin-1, else the next of those from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def merged(symbols: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The encoding of symbols: the pair of the least rank is merged first, of equal ones the leftmost."""
    if len(symbols) < 48:  # a scan for the least rank costs less than a heap
        none, made = 1 << 62, (1 << _ID_BITS) - 1
        out, at = list(symbols), list(map(merges.get, zip(symbols, symbols[1:]), repeat(none)))
        while at and (best := min(at)) != none:
            i = at.index(best)
            out[i : i + 2] = [best & made]
            del at[i]
            if i:
                at[i - 1] = merges.get((out[i - 1], out[i]), none)
            if i < len(at):
                at[i] = merges.get((out[i], out[i + 1]), none)
        return out
    token: list[int | None] = list(symbols)
    after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
    queue = [(merges[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if token[i] != a or j >= len(token) or token[j] != b:
            continue  # one of the two has been merged meanwhile
        token[i], token[j] = merges[a, b] & ((1 << _ID_BITS) - 1), None
        after[i] = after[j]
        if after[i] < len(token):
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(token) and (p := (token[left], token[right])) in merges:
                heapq.heappush(queue, (merges[p], left, *p))
    return [t for t in token if t is not None]


class Encoder:
    """Encodes words, leaves and whole texts with a vocabulary; one for each task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.words = regex.compile(vocabulary.pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.known_words, self.known_runs = _remembered.setdefault(vocabulary.key, ({}, {}))
        self._library = None

    def leaf(self, data: bytes, last: bool) -> list[int]:
        """The encoding of some bytes of a word; ``last``: the word ends with them."""
        v = self.vocabulary
        symbols = [v.inner[b] for b in data]
        if last and data:
            symbols[-1] = v.final[data[-1]]
        return merged(symbols, v.merges)

    def symbols(self, ids: list[int]) -> list[int]:
        """The symbols that tokens are made of."""
        out, stack, parts = [], ids[::-1], self.vocabulary.parts
        while stack:
            t = stack.pop()
            if t in parts:
                stack += parts[t][::-1]
            else:
                out.append(t)
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring pieces of a word from their encodings (see above)."""
        if not left or not right:
            return left + right
        k, m = 1, 1  # tokens of the left and of the right side in the window
        while True:
            window = merged(self.symbols(left[-k:] + right[:m]), self.vocabulary.merges)
            left_agrees = k == len(left) or window[0] == left[-k]
            right_agrees = m == len(right) or window[-1] == right[m - 1]
            if left_agrees and right_agrees:
                return left[:-k] + window + right[m:]
            k = k if left_agrees else min(2 * k, len(left))
            m = m if right_agrees else min(2 * m, len(right))

    def normalised(self, text: str) -> tuple[str, list[str] | None]:
        """Lower-case text in composed form, and its words if they are known already.

        Characters that are newer than Python's tables are left to the library, so that both have the same words.
        """
        if text.isascii():
            return text.lower(), None
        if _SETTLED.fullmatch(text):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower(), None  # a final sigma is not told apart
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.vocabulary.rules)
            self._bytes = {c: b for b, c in enumerate(_byte_letters())}
        text = self._library.normalizer.normalize_str(text)
        found = self._library.pre_tokenizer.pre_tokenize_str(text)
        return text, [bytes(self._bytes[c] for c in word).decode() for word, _ in found]

    def pieces(self, text: str) -> Iterator[tuple[int | None, str]]:
        """The words of a text in order: (None, word), or (id, "") for an added token."""
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                yield self.vocabulary.added[part], ""
            elif part:
                lowered, words = self.normalised(part)
                for word in self.words.findall(lowered) if words is None else words:
                    yield None, word

    def words_of(self, words: list[str]) -> bytes:
        """The ids of words, packed."""
        out = list(map(self.known_words.get, words))
        if None in out:
            for i, packed in enumerate(out):
                if packed is None:
                    out[i] = array("I", self.leaf(words[i].encode(), True)).tobytes()
                    _remember(self.known_words, words[i], out[i])
        return b"".join(out)

    def runs_of(self, runs: list[str]) -> bytes:
        """The ids of normalised text between white space, packed."""
        out = list(map(self.known_runs.get, runs))
        if None in out:
            for i, packed in enumerate(out):
                if packed is None:
                    out[i] = self.words_of(self.words.findall(runs[i]))
                    _remember(self.known_runs, runs[i], out[i])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed; whatever it holds is encoded at once.

        No word goes over white space, so runs between it are encoded by themselves, and remembered.
        """
        out = []
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                out.append(array("I", [self.vocabulary.added[part]]).tobytes())
            elif part:
                lowered, words = self.normalised(part)
                if words is None and not _SEPARATORS.search(lowered):
                    out.append(self.runs_of(lowered.split()))
                else:  # those separators are white space to Python, but not to the pattern
                    out.append(self.words_of(self.words.findall(lowered) if words is None else words))
        return b"".join(out)


def _long_run(text: Column, leaf: int) -> Column:
    """Whether a text may hold a word of more than ``leaf`` bytes: a run of so many characters without white space, counted at
    three lower-case characters of four bytes at most for one character."""
    most = max(1, leaf // 12)
    return (F.char_length(text) > most) & text.rlike(rf"(?<!\S)\S{{{most},}}")


def _whole(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for doc_ids, texts in rows_of(batches, ["doc_id", "text"], len, 4_000_000):
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array([encoder.encode(t) for t in texts], pa.binary())], names=["doc_id", "ids"])

    return run


_PIECES = "row long, doc_id long, piece long, node long, nodes long, last boolean, data binary"


def _cut(vocabulary: Vocabulary, leaf: int, bundle: int = 32_768) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pieces of each text in order: bundles of words, each word behind its length (nodes = 0), ids of added tokens (nodes = -1), and the
    leaves of long words (nodes: how many the word has)."""

    def of(encoder: Encoder, text: str) -> Iterator[tuple[int, int, bool, bytes]]:
        held: list[bytes] = []
        size = 0
        for special, word in encoder.pieces(text):
            data = b"" if special is not None else word.encode()
            if held and (special is not None or len(data) > leaf or size > bundle):
                yield 0, 0, True, b"".join(held)
                held, size = [], 0
            if special is not None:
                yield 0, -1, True, np.array([special], "<u4").tobytes()
            elif len(data) > leaf:
                nodes = -(-len(data) // leaf)
                for node in range(nodes):
                    yield node, nodes, node == nodes - 1, data[node * leaf : (node + 1) * leaf]
            else:
                held.append(len(data).to_bytes(4, "little") + data)
                size += len(data)
        yield 0, 0, True, b"".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("node", pa.int64()), ("nodes", pa.int64()), ("last", pa.bool_()), ("data", pa.binary())])
        for rows, doc_ids, texts in rows_of(batches, ["row", "doc_id", "text"], len, 1):
            for row, doc_id, text in zip(rows, doc_ids, texts, strict=True):
                held, size, piece = [], 0, -1
                for node, nodes, last, data in of(encoder, text):
                    piece += node == 0
                    held.append((row, doc_id, piece, node, nodes, last, data))
                    size += len(data)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


_NODES = "row long, doc_id long, piece long, node long, nodes long, ids binary"


def _leaves(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)

        def encode(nodes: int, last: bool, data: bytes) -> bytes:
            if nodes < 0:
                return data
            if nodes:
                return np.array(encoder.leaf(data, last), "<u4").tobytes()
            out, at = [], 0
            while at < len(data):
                size = int.from_bytes(data[at : at + 4], "little")
                out.append(encoder.words_of([data[at + 4 : at + 4 + size].decode()]))
                at += 4 + size
            return b"".join(out)

        for batch in batches:
            nodes, last, data = (batch.column(i).to_pylist() for i in (4, 5, 6))
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(map(encode, nodes, last, data), pa.binary())], names=["row", "doc_id", "piece", "node", "nodes", "ids"])

    return run


def _pair(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)

        def join(left: bytes, right: bytes | None) -> bytes:
            if right is None:
                return left
            return np.array(encoder.joined(*(np.frombuffer(x, "<u4").tolist() for x in (left, right))), "<u4").tobytes()

        for batch in batches:
            left, right = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(map(join, left, right), pa.binary())], names=["row", "doc_id", "piece", "node", "nodes", "ids"])

    return run


def _one_text(pieces: pa.Table) -> pa.Table:
    pieces = pieces.sort_by("piece")
    return pa.table({"doc_id": pieces["doc_id"][:1], "ids": pa.array([b"".join(pieces["ids"].to_pylist())], pa.binary())})


def _by_tree(docs: DataFrame, vocabulary: Vocabulary, leaf: int) -> DataFrame:
    """(doc_id, ids) of texts that may hold long words, in parallel within each text."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = materialize(numbered.mapInArrow(_cut(vocabulary, leaf), _PIECES), "bpe-pieces")
    encoded = pieces.repartition("row", "piece", "node").mapInArrow(_leaves(vocabulary), _NODES)
    most = pieces.agg(F.max("nodes")).first()[0] or 0
    if most <= 1:
        return encoded.groupBy("row").applyInArrow(_one_text, "doc_id long, ids binary")
    encoded = materialize(encoded, "bpe-leaves")
    whole, tree = encoded.where("nodes < 1").select("row", "doc_id", "piece", "ids"), encoded.where("nodes > 0")
    while most > 1:
        left = tree.where("node % 2 = 0")
        right = tree.where("node % 2 = 1").select("row", "piece", (F.col("node") - 1).alias("node"), F.col("ids").alias("right"))
        pairs = left.join(right, ["row", "piece", "node"], "left").select("row", "doc_id", "piece", F.expr("node div 2").alias("node"), "nodes", "ids", "right")
        tree, most = materialize(pairs.mapInArrow(_pair(vocabulary), _NODES), "bpe-tree"), -(-most // 2)
    return whole.union(tree.select("row", "doc_id", "piece", "ids")).groupBy("row").applyInArrow(_one_text, "doc_id long, ids binary")


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens: long, ids: binary) for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``ids`` are the tokens of the whole text as little-endian unsigned 32-bit numbers.  A null or empty text has none; rows that repeat, and
    null ids, each give a row.  A very long text without long runs is encoded by one task, as it lies in one
    row; one with a run of over a twelfth of ``leaf`` characters is cut and encoded by all.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ordinary = rows.where(~_long_run(F.col("text"), leaf)).mapInArrow(_whole(vocabulary), "doc_id long, ids binary")
    found = ordinary.union(_by_tree(rows.where(_long_run(F.col("text"), leaf)), vocabulary, leaf))
    return found.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with a column decoded: the text of its ids, tokens joined by one space as the files without a decoder have it.

    Added tokens are kept.  Null ids are decoded as none; an id beyond the vocabulary has no text and is passed over.
    """
    tokens = vocabulary.tokens
    names = encoded.columns
    if "decoded" in names:
        raise ValueError("there is a column decoded already")

    def text(ids: bytes | None) -> str:
        found = np.frombuffer(ids or b"", "<u4")
        if len(found) and found.max() >= len(tokens):
            found = found[found < len(tokens)]
        return " ".join(map(tokens.__getitem__, found.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, low, texts, size = batch.column(names.index("ids")), 0, [], 0
            for i in range(len(batch)):
                texts.append(text(column[i].as_py()))
                size += len(texts[-1])
                if size > 4_000_000 or i == len(batch) - 1:
                    part = batch.slice(low, len(texts))
                    yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])
                    low, texts, size = i + 1, [], 0

    schema = encoded.schema
    return encoded.mapInArrow(run, type(schema)(list(schema.fields)).add("decoded", "string"))
