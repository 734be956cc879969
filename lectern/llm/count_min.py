"""A count-min sketch built in parts over a DataFrame and merged block by block.

Each task counts the cells that its hashes fall into and sends, for each block of cells, the sorted cells it touched as
compressed differences, with their counts. Blocks are merged on the executors; what leaves them is one bit a cell: touched
at least `least` times in all. An item is estimated frequent if that bit is set in every row, so an item that occurs so
often is never missed, and any other is reported only by collision.

The merged bits are gathered and broadcast; their size is chosen from the number of items but never exceeds
DEPTH * 2**most_bits / 8 bytes. Past that bound the estimates get looser, never wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import batched, mix64

DEPTH = 2
BLOCK_BITS = 20
FLUSH = 1 << 20


def row_bits(n_items: int, most_bits: int = 29, least_bits: int = BLOCK_BITS) -> int:
    """log2 of the cells in a row: about four for each item, within bounds."""
    return min(most_bits, max(least_bits, int(4 * max(n_items, 1)).bit_length()))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    x = hashes if row == 0 else mix64(hashes ^ np.uint64(0x5851F42D4C957F2D * row))
    return x & np.uint64((1 << bits) - 1)


def pack_sorted(x: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct cells of a block, as byte planes of their differences, and a count up to 255 for each; compressed."""
    d = np.diff(x.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    planes = d.view(np.uint8).reshape(-1, 4).T
    return len(x).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())


def unpack_sorted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    d = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(d, dtype=np.int64), raw[4 * n :]


def parts(held: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """One task's share of the sketch, by blocks of cells: (block, compressed counts)."""
    h = np.concatenate(held)
    for row in range(DEPTH):
        c, n = np.unique(cells(h, row, bits).astype(np.uint32), return_counts=True)
        where = np.searchsorted(c, np.arange(0, (1 << bits) + 1, 1 << BLOCK_BITS))
        for k in range(len(where) - 1):
            a, b = where[k], where[k + 1]
            if a < b:
                yield row << 40 | k, pack_sorted(c[a:b] & np.uint32((1 << BLOCK_BITS) - 1), n[a:b])


SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.binary())])


def merged(shares: DataFrame, bits: int, least: int = 2) -> bytes:
    """The merged bits, DEPTH rows of 2**bits, row after row. shares: rows (block, part) of all tasks. least: up to 255, where
    counts stop."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            block, n = None, None
            for batch in batches:
                for b, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if b != block:
                        if block is not None and (n >= least).any():
                            yield block, zstandard.ZstdCompressor(level=1).compress(np.packbits(n >= least).tobytes())
                        block, n = b, np.zeros(1 << BLOCK_BITS, np.uint16)
                    at, more = unpack_sorted(part)
                    n[at] = np.minimum(n[at] + more, 255)
            if block is not None and (n >= least).any():
                yield block, zstandard.ZstdCompressor(level=1).compress(np.packbits(n >= least).tobytes())

        return batched(rows(), SCHEMA)

    out = np.zeros((DEPTH << bits) // 8, np.uint8)
    size = (1 << BLOCK_BITS) // 8
    for r in shares.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, part binary").toLocalIterator():
        at = ((r["block"] >> 40 << bits) >> 3) + (r["block"] & (1 << 40) - 1) * size
        out[at : at + size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["part"]), np.uint8)
    return out.tobytes()


def frequent_bits(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int = 2) -> bytes:
    """merged() over the hashes of df's rows. hashes: the 64-bit hashes of a batch, in pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for batch in batches:
                for h in hashes(batch):
                    held.append(h)
                    size += len(h)
                    if size >= FLUSH:
                        yield from parts(held, bits)
                        held, size = [], 0
            if size:
                yield from parts(held, bits)

        return batched(rows(), SCHEMA)

    return merged(df.mapInArrow(count, "block long, part binary"), bits, least)


def estimated_frequent(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes are estimated to occur as often as the sketch asked for. sketch: the merged bits as bytes."""
    found = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        c = cells(hashes, row, bits)
        at = (c >> np.uint64(3)).astype(np.int64) + ((row << bits) >> 3)
        found &= (sketch[at] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return found
