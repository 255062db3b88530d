"""Which hashed cells do two documents or more fall into? One bit a cell, merged from the tasks' own sketches."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BITS = 16
MOST_BITS = 29


def bits_for(cells: float) -> int:
    """Power of 2 of at least so many cells; at most 2**29 cells (64 MB of bits)."""
    return int(min(MOST_BITS, max(CHUNK_BITS, np.ceil(np.log2(max(1.0, cells))))))


def fits(cells: float) -> bool:
    """Does a row of so many cells stay within 2**MOST_BITS?"""
    return cells <= 1 << MOST_BITS


def packed(cells: np.ndarray, rows: int = 1, row: int = 0) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """By chunk of cells: number, the cells hit (2 bytes each), and a bit for each that is hit twice or more. Sorts cells in place."""
    cells.sort()
    first = np.concatenate([[True], cells[1:] != cells[:-1]])
    twice = np.append(~first[1:], False)[first]  # the next one is the same cell
    cells = cells[first]
    chunk, low = cells >> CHUNK_BITS, (cells & ((1 << CHUNK_BITS) - 1)).astype("<u2")
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    ends = [0, *cuts.tolist(), len(cells)]
    return (chunk[ends[:-1]] * rows + row).astype(np.int64), [low[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], [np.packbits(twice[a:z]).tobytes() for a, z in zip(ends, ends[1:], strict=False)]


def merged(found: DataFrame, bits: int, rows: int = 1) -> np.ndarray:
    """found: chunk long, cells binary, twice binary. Bits (packed, one array a row) of the cells hit twice or more in all."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more, now = None, None, None

        def done():
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([np.packbits(more).tobytes()])], ["chunk", "bits"])

        for b in batches:
            for chunk, cells, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, once, more = chunk, np.zeros(1 << CHUNK_BITS, bool), np.zeros(1 << CHUNK_BITS, bool)
                low = np.frombuffer(cells, "<u2")
                more[low[once[low]]] = True
                once[low] = True
                more[low[np.unpackbits(np.frombuffer(twice, np.uint8), count=len(low)).astype(bool)]] = True
        if now is not None:
            yield done()

    out = np.zeros((rows, 1 << max(bits - 3, 0)), dtype=np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    for r in found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk long, bits binary").collect():  # at most 64 MB a row
        chunk, row = divmod(r["chunk"], rows)
        out[row, chunk * size:(chunk + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0
