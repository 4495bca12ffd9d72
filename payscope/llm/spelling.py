"""Spelling variants grouped by anagram hashing (operator 13).

The anagram key of a word is the sum of the fifth powers of its letters' code points, whatever their order.  One letter added, removed or
exchanged changes it by that letter's power or by the difference of two.  So each word is listed under its own key and under the keys
that are left when one of its letters is taken away: words that differ by one letter then meet under a key, one of them with a letter
taken away or both.  Where they meet, the order of their letters is verified.

Under a key only words meet whose remainders (the word without the letter, at each place where it stands) are equal as strings, so no pairs
are made of a key's words that are anagrams and nothing else.  Keys with more than ``MEET`` words are dealt to several tasks by
the remainders.  Words that share a remainder are at most as many as the letters times the places.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.shared import materialize

#: One occurrence in so many gets a letter deleted, by the hash of document and word.
DAMAGE = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
POWER = 5
#: Keys of more words are dealt to several tasks.
MEET = 2048
#: More such keys than this are joined by shuffle instead of broadcast.
MOST_BROADCAST_KEYS = 200_000
#: Distinct words that a task counts before it hands them over.
HELD_WORDS = 200_000
_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
_LATIN = bytes((c + 32 if c <= 0x5A else c) if c in _LETTERS else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The runs of letters of a text in lower case (A-Z only), in Latin-1: characters beyond it are no letters here."""
    return (text or "").encode("latin-1", "replace").translate(_LATIN).split()


def damaged(doc_id: int | None, word: bytes) -> bytes:
    """The word as this document is taken to spell it; a null doc_id counts as the empty text."""
    plain = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(plain, zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n: long): the words of at least 5 letters that stand in the texts at least 3 times.

    Each task counts what it reads before words are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            long_enough = [(w, n) for w, n in held.items() if len(w) >= LEAST_LETTERS]
            held.clear()
            return pa.record_batch([pa.array([w.decode("latin-1") for w, _ in long_enough], pa.string()), pa.array([n for _, n in long_enough], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(words_of(text.as_py()))
                for word, n in found.items():
                    held[damaged(doc_id, word)] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def anagram_key(word: str) -> int:
    """The sum of the letters' powers, as a signed number of 64 bits."""
    return _wrapped(sum(n * ord(c) ** POWER for c, n in Counter(word).items()))


def _wrapped(key: int) -> int:
    return (key + (1 << 63)) % (1 << 64) - (1 << 63)


def _under_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under its own key (letter: empty) and under the key without each of its letters."""
    for batch in batches:
        keys, letters, words, counts = [], [], [], []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = anagram_key(word)
            for letter in ("", *sorted(set(word))):
                keys.append(_wrapped(key - (ord(letter) ** POWER if letter else 0)))
                letters.append(letter)
                words.append(word)
                counts.append(n)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(letters, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["key", "letter", "word", "n"])


def _remainders(word: str, letter: str) -> Iterator[tuple[int, int]]:
    """(place, hash of the word without the letter there) for each place of the letter; the word itself at place -1 without one.

    The hash is of the letters and their places after removal, so all places take one walk over the word, however long it is.
    """
    size = (1 << 61) - 1
    if not letter:
        total = 0
        for c in word:
            total = (total * 1_000_003 + ord(c)) % size
        yield -1, total
        return
    # The hash without place i: that of what is before it, moved by what is after it, and that of what is after it.
    after, power = [0] * (len(word) + 1), [1] * (len(word) + 1)
    for i in range(len(word) - 1, -1, -1):
        after[i] = (after[i + 1] + ord(word[i]) * power[len(word) - 1 - i]) % size
        power[len(word) - i] = power[len(word) - 1 - i] * 1_000_003 % size
    before = 0
    for i, c in enumerate(word):
        if c == letter:
            yield i, (before * power[len(word) - 1 - i] + after[i + 1]) % size
        before = (before * 1_000_003 + ord(c)) % size


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of hot keys once for each share that one of their remainders falls to."""
    for batch in batches:
        rows = []
        for key, letter, word, n, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shares = int(shares)
            rows += [(key, share, letter, word, n) for share in ([0] if shares == 1 else sorted({h % shares for _, h in _remainders(word, letter)}))]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "share", "letter", "word", "n"])


def _met(rows: list[tuple[str, str, int]], share: int, shares: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, n of the greatest of them, it) of the words under one key, as far as they meet in this share."""
    if len(rows) < 2:
        return
    groups: dict[int, dict[int, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))
    for letter, word, n in rows:
        for place, h in _remainders(word, letter):
            if shares == 1 or h % shares == share:
                groups[h][place].append((word, n))
    for places in groups.values():
        whole = places.pop(-1, [])
        for one in places.values():  # both have lost a letter at the same place: exchanged
            if len(one) > 1:
                yield from _each_other(one)
        lost = sorted({w for one in places.values() for w in one})
        for word, n in whole:  # what another word is without a letter; equal hashes of other words don't pass
            longer = [(w, m) for w, m in lost if near(word, w)]
            if longer:
                m, best = min((-m, w) for w, m in longer)
                yield word, len(longer), -m, best
                for w, _ in longer:
                    yield w, 1, n, word


def _each_other(words: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """The same for words that have the same remainder at the same place: each is near all others.

    The remainders are compared as strings, should their hashes be equal by chance.
    """
    if any(not near(words[0][0], w) for w, _ in words[1:]):
        for w, n in words:
            found = sorted((-m, x) for x, m in words if near(w, x))
            if found:
                yield w, len(found), -found[0][0], found[0][1]
        return
    first, second = sorted((-n, w) for w, n in words)[:2]
    for w, _ in words:
        m, best = first if w != first[1] else second
        yield w, len(words) - 1, -m, best


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each word meets under each key; the rows come sorted by key and share."""
    found: list[tuple[str, int, int, str]] = []
    held: list[tuple[str, str, int]] = []
    at: tuple[int, int, int] | None = None

    def flush() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        out = pa.record_batch([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["word", "n_near", "form_n", "form"])
        found.clear()
        return out

    for batch in batches:
        for key, share, shares, letter, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, share, shares) != at:
                if at:
                    found += _met(held, at[1], at[2])
                at = (key, share, shares)
                held = []
                if len(found) > 100_000:
                    yield flush()
            held.append((letter, word, n))
    if at:
        found += _met(held, at[1], at[2])
    yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) for every word of ``words`` (word, n; words are distinct) that has near words: how many, and the
    one of greatest n, of equal ones the first in code-point order."""
    listed = materialize(words.select("word", "n").mapInArrow(_under_keys, "key long, letter string, word string, n long"), "spelling-keys")
    hot = materialize(listed.groupBy("key").count().where(F.col("count") > MEET).select("key", F.ceil(F.col("count") / MEET).alias("shares")), "spelling-hot")
    hint = F.broadcast if hot.count() <= MOST_BROADCAST_KEYS else lambda df: df
    shared = listed.join(hint(hot), "key")
    dealt = shared.select("key", "letter", "word", "n", "shares").mapInArrow(_dealt, "key long, share long, letter string, word string, n long").join(hint(hot), "key")
    # A key with one word has no pairs; the rows of the others meet by key.
    common = listed.join(hint(hot), "key", "left_anti").select("key", F.lit(0).cast("long").alias("share"), F.lit(1).cast("long").alias("shares"), "letter", "word", "n")
    units = common.union(dealt.select("key", "share", F.col("shares").cast("long"), "letter", "word", "n"))
    met = units.repartition("key", "share").sortWithinPartitions("key", "share").mapInArrow(_pairs, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with a column root: where following the forms ends, the word itself if it has none.

    Each round doubles the way that is known, so rounds grow with the logarithm of the longest way.  A form
    stands at least twice as often as its word, so there are no circles.
    """
    known = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        # Only words that are some word's root so far and have a further one lead on.
        on = known.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(known.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return forms.join(known, "word")


def group_spellings(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts of ``docs`` (doc_id, text; others are ignored).

    Words are those of ``count_words``.  A word's form is its near word of greatest n, if it stands at least twice as often.  Null and
    empty texts have no words; rows that repeat count again; without words there are no rows.  A run of letters
    may be as long as its text.
    """
    words = materialize(count_words(docs), "spelling-words")
    found = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= 2 * F.col("n")
    forms = materialize(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


#: DuckDB SQL for the query: CRC-32 by its table, near words by equal remainders as strings, roots by recursion.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS steps),
runs AS (
  SELECT doc_id, word, count(*)::BIGINT AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS word FROM documents)
  GROUP BY ALL),
coded AS (SELECT word, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || word)) AS digits FROM runs),
hashed AS (
  SELECT word, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(length(digits) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1)::UBIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::BIGINT + 1]))) AS h
  FROM coded, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, (h % length(word))::BIGINT) || substr(word, (h % length(word))::BIGINT + 2) ELSE word END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
lost AS (SELECT word, place, substr(word, 1, place - 1) || substr(word, place + 1) AS remainder FROM (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM lost a JOIN lost b ON a.remainder = b.remainder AND a.place = b.place AND a.word <> b.word
  UNION SELECT lost.word, words.word FROM lost JOIN words ON lost.remainder = words.word
  UNION SELECT words.word, lost.word FROM lost JOIN words ON lost.remainder = words.word),
found AS (
  SELECT a AS word, count(*)::BIGINT AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n
  FROM pairs JOIN words ON words.word = b GROUP BY a),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END::BIGINT AS form_n
  FROM words LEFT JOIN found USING (word)),
ways AS (
  SELECT word, word AS last_form, 0 AS steps FROM forms
  UNION ALL SELECT ways.word, forms.form, steps + 1 FROM ways JOIN forms ON forms.word = ways.last_form WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(last_form, steps) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
