"""Words of texts as 64-bit hashes, a slice of rows at a time."""

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import SparkSession

#: Odd multipliers for mixing hashes, from the splitmix64 generator.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
SLICE_CHARS = 1 << 20
BATCH_BYTES = 4 << 20


class WordHashes(dict):
    """Hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def bound_batches(spark: SparkSession) -> None:
    """Have Spark hand Python at most BATCH_BYTES (or one row) at a time; a smaller limit of the session stays.

    Spark's own limit is 64 MB, of which a task holds copies on both sides.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]?)b?", spark.conf.get(key).lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def tidied(run: Callable) -> Callable:
    """run, a function over batches, that gives free memory back to the system when a task ends: idle workers stay small."""
    def work(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)
    return work


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than ASCII white space; lower changes A-Z only."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[1]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[2]
    return x ^ (x >> np.uint64(31))


def flat_hashes(word_lists: Iterable[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in one array, and each text's start in it (with the end)."""
    sizes, values = [], []
    for words in word_lists:
        sizes.append(len(words))
        values.extend(map(cache.__getitem__, words))
    return np.array(values, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def window_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (shorter by n - 1); order counts."""
    if len(flat) < n:
        return flat[:0]
    out = np.zeros(len(flat) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out + flat[k:len(flat) - n + 1 + k] + MIX[0])
    return out


def window_owner(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-word windows that lie within one text: their positions in the flat array, and their text's number."""
    sizes = np.maximum(np.diff(starts) - (n - 1), 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return np.arange(sizes.sum()) - first[owner] + starts[:-1][owner], owner


def parts(batch: pa.RecordBatch, text_at: int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of text (a longer text stands alone)."""
    sizes = [x or 0 for x in pa.compute.binary_length(batch.column(text_at)).to_pylist()]
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (end == at or held + sizes[end] <= most):
            held += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def slices(batch: pa.RecordBatch, text_at: int, most: int = SLICE_CHARS) -> Iterator[tuple[list, ...]]:
    """The columns of such parts, as lists."""
    for part in parts(batch, text_at, most):
        yield tuple(c.to_pylist() for c in part.columns)
