"""Words of whole texts as arrays: their CRC-32, length and document, run by run.

A word is a longest stretch of a-z, 0-9 and signs beyond ASCII, after A-Z are lower-cased. Texts are taken as
the bytes of an Arrow column, in runs of a bounded number of bytes; a longer text passes in several runs that are cut
between words, and each of its runs begins with the last words of the run before, so that
pairs and wider groups of words are complete.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at once.
RUN_BYTES = 1 << 20
#: Longer words are hashed one by one.
SHORT_WORD = 32


def _byte_table() -> np.ndarray:
    """The register of CRC-32 after one byte, for each byte (polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CRC = _byte_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _zeros_tables(doublings: int = 31) -> list[np.ndarray]:
    """For 1, 2, 4, ... zero bytes: what each of a register's four bytes becomes under them."""
    table = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    table = _CRC[table & 255] ^ (table >> 8)
    tables = [table]
    for _ in range(doublings - 1):
        tables.append(_through(tables[-1], tables[-1]))
    return tables


def _through(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    return table[0][value & 255] ^ table[1][(value >> 8) & 255] ^ table[2][(value >> 16) & 255] ^ table[3][value >> 24]


_ZEROS = _zeros_tables()


def followed_by(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of one string followed by another one, from both strings' values and the second's length in bytes."""
    out = crc.copy()
    top = int(length.max()) if len(length) else 0
    for bit in range(top.bit_length()):
        has = np.flatnonzero((length >> bit) & 1)
        out[has] = _through(_ZEROS[bit], out[has])
    return out ^ after


def with_blank(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with one blank more at their end."""
    register = ~crc
    return ~(_CRC[(register ^ 32) & 255] ^ (register >> 8))


class WordRun(NamedTuple):
    """Words in their order. The first ``again`` of them end the run before and count for pairs only.

    ``heads`` has, for each number of bytes asked for, the places of the longer words and the CRC-32 of their first bytes.
    """

    doc: np.ndarray
    crc: np.ndarray
    length: np.ndarray
    again: int
    heads: list[tuple[np.ndarray, np.ndarray]]

    def pairs(self, apart: int = 1) -> np.ndarray:
        """Places of the second word of all pairs so far apart within a document that end at a word of this run."""
        at = np.arange(max(apart, self.again), len(self.doc))
        return at[self.doc[at] == self.doc[at - apart]]


def _hashed(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of lower-cased bytes, all of them byte by byte in step."""
    order = np.argsort(-np.minimum(length, SHORT_WORD + 1), kind="stable")
    begin, sizes = starts[order], length[order]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-sizes.clip(max=SHORT_WORD + 1), -SHORT_WORD, side="left"))  # those before are long
    sizes = sizes[first:]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        n = first + int(np.searchsorted(-sizes, -step, side="left"))
        part = register[first:n]
        register[first:n] = _CRC[(part ^ data[begin[first:n] + step]) & 255] ^ (part >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~register
    for at in order[:first]:
        out[at] = zlib.crc32(data[starts[at] : starts[at] + length[at]].tobytes())
    return out


def _headed(data: np.ndarray, starts: np.ndarray, length: np.ndarray, heads: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length in ascending order: the words that are longer, and the CRC-32 of so many of their bytes."""
    out, done = [], 0
    place = np.arange(len(starts))
    register = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for head in heads:
        longer = length[place] > head
        place, register = place[longer], register[longer]
        for step in range(done, head):
            register = _CRC[(register ^ data[starts[place] + step]) & 255] ^ (register >> 8)
        done = head
        out.append((place, ~register))
    return out


def _cuts(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """A text's bytes in stretches of about ``RUN_BYTES`` that end between words."""
    while begin < end:
        cut = min(end, begin + RUN_BYTES)
        while cut < end and _IN_WORD[_LOWER[data[cut]]] and _IN_WORD[_LOWER[data[cut - 1]]]:
            ahead = np.flatnonzero(~_IN_WORD[_LOWER[data[cut : cut + RUN_BYTES]]])
            cut = min(end, cut + (int(ahead[0]) if len(ahead) else RUN_BYTES))
        yield begin, cut
        begin = cut


def word_runs(texts: pa.Array, carried: int = 2, heads: tuple[int, ...] = ()) -> Iterator[WordRun]:
    """The words of a column of strings (null: no words); ``doc`` is the row in the column. ``heads`` ascends."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, held = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[stop])
        last = WordRun(*(np.empty(0, kind) for kind in (np.int64, np.uint32, np.int64)), 0, [])
        for low, high in _cuts(data, begin, end) if stop == at + 1 else [(begin, end)]:
            block = _LOWER[data[low:high]]
            inside = _IN_WORD[block]
            edge = np.zeros(len(block) + 1, bool)  # a text begins here
            edge[(offsets[at:stop] - low).clip(0, len(block))] = True
            starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
            ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
            length = ends - starts
            doc = np.searchsorted(offsets[at:stop], starts + low, side="right") - 1 + at
            keep = slice(max(0, len(last.doc) - carried), None)
            again = len(last.doc[keep])
            last = WordRun(
                np.concatenate([last.doc[keep], doc]), np.concatenate([last.crc[keep], _hashed(block, starts, length)]),
                np.concatenate([last.length[keep], length]), again, [(place + again, crc) for place, crc in _headed(block, starts, length, heads)],
            )
            yield last
        at = stop
