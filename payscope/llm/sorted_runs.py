"""Front-coded sorted runs of fixed-width byte strings, and the loser tree that merges them.

A run stores, for each string, how many bytes it shares with the one before and then the rest.  The
merge compares two strings only from the prefix that both are known to share with the last output.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Rows that carry runs from task to task.
RUN_ROWS = "part int, kind string, run binary"


def pack(**arrays: np.ndarray) -> bytes:
    head = json.dumps({k: [a.dtype.str, len(a)] for k, a in arrays.items()}).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays.values())
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:4], "little")
    at, out = 4 + n, {}
    for k, (kind, size) in json.loads(body[4:at]).items():
        out[k] = np.frombuffer(body, kind, size, at)
        at += out[k].nbytes
    return out


def run_rows(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    parts, kinds, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(kinds, pa.string()), pa.array(blobs, pa.binary())], names=["part", "kind", "run"])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """The runs of each partition; the input is sorted by it."""
    part, runs = -1, []
    for batch in batches:
        for p, kind, run in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if p != part and runs:
                yield part, runs
                runs = []
            part = p
            runs.append((kind, run))
    if runs:
        yield part, runs


def part_slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slices of equal values of an ascending array."""
    if len(part):
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(at, np.r_[at[1:], len(part)], strict=True):
            yield int(part[a]), slice(int(a), int(b))


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """For each row of a sorted byte matrix, the bytes it shares with the row before (0 for the first)."""
    out = np.zeros(len(rows), np.uint8)
    for at in range(1, len(rows), 65536):
        differ = rows[at : at + 65536] != rows[at - 1 : at - 1 + len(rows[at : at + 65536])]
        out[at : at + 65536] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def sorted_order(rows: np.ndarray) -> np.ndarray:
    """A stable order of the rows of a byte matrix whose last byte is never zero."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1), kind="stable")


def front_coded(rows: np.ndarray, **more: np.ndarray) -> bytes:
    """A run of sorted, distinct rows; ``more``: what goes with each of them."""
    shared = shared_prefixes(rows)
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return pack(shared=shared, rest=rest, **more)


@dataclasses.dataclass
class Run:
    """One run while it is read: the next string, and what it shares with the one before."""

    width: int
    shared: list[int]
    rest: bytes
    at: int = -1
    offset: int = 0
    key: bytes = b""

    def advance(self) -> int:
        """Step to the next string; its known shared prefix, or -1 at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return -1
        n = self.shared[self.at]
        end = self.offset + self.width - n
        self.key = self.key[:n] + self.rest[self.offset : end]
        self.offset = end
        return n


def merged(runs: list[dict[str, np.ndarray]], width: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(string, bytes shared with the string before, run, place in the run), ascending.

    A tournament tree of losers.  Each loser keeps the length of the prefix it shares with the
    string it lost to, which is the last output once that has left the tree: of two strings the one
    that shares more with it is the smaller, and only of equals are bytes compared, behind that prefix.
    """
    players = [Run(width, r["shared"].tolist(), r["rest"].tobytes()) for r in runs]
    k = 1
    while k < len(players):
        k *= 2
    players += [Run(width, [], b"") for _ in range(k - len(players))]
    known = [p.advance() for p in players]
    loser = [-1] * k
    shared = [0] * k

    def play(a: int, na: int, b: int, nb: int) -> tuple[int, int, int, int]:
        """(winner, its shared prefix, loser, its prefix shared with the winner)."""
        if na != nb:
            return (a, na, b, nb) if na > nb else (b, nb, a, na)
        if na < 0:
            return a, na, b, nb
        x, y = players[a].key[na:], players[b].key[na:]
        if x == y:
            return (a, na, b, width) if a < b else (b, na, a, width)
        differ = int.from_bytes(x) ^ int.from_bytes(y)
        same = width - (differ.bit_length() + 7) // 8
        return (a, na, b, same) if x < y else (b, na, a, same)

    winners: list[tuple[int, int]] = [(-1, -1)] * k + list(enumerate(known))
    for node in range(k - 1, 0, -1):
        (a, na), (b, nb) = winners[2 * node], winners[2 * node + 1]
        best, n, loser[node], shared[node] = play(a, na, b, nb)
        winners[node] = (best, n)
    best, n = winners[1]
    while n >= 0:
        player = players[best]
        yield player.key, n, best, player.at
        n = player.advance()
        node = (best + k) // 2
        while node:
            if n > shared[node]:
                pass
            elif n < shared[node]:
                best, loser[node] = loser[node], best
                n, shared[node] = shared[node], n
            elif n >= 0:
                best, n, loser[node], shared[node] = play(best, n, loser[node], shared[node])
            node //= 2
