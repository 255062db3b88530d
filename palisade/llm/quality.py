"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Both multinomials are counts of hashed words and byte triples of words: the raw one over every document, the trusted one over a
bounded sample of documents labelled good. A document's score is the mean log ratio of its n-grams, so length doesn't
count; a document below the threshold goes, whatever else is in the table.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.words import MIX, bound_batches, mix, parts, slices, tidied, window_hashes, window_owner, words_of

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
PRIOR = 20.0
THRESHOLD = -0.25
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


class Slice:
    """N-grams of some texts: each word, and the three bytes around each of its bytes (a space at either end)."""

    def __init__(self, word_lists: Iterable[list[bytes]], buckets: int):
        numbers: dict[bytes, int] = {}
        flat, sizes = [], []
        for words in word_lists:
            sizes.append(len(words))
            flat += [numbers.setdefault(w, len(numbers)) for w in words]
        self.flat = np.array(flat, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        shift, n = np.uint64(64 - (buckets - 1).bit_length()), len(numbers)
        self.word = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), dtype=np.uint64, count=n)) >> shift
        text = np.frombuffer(b" " + b" ".join(numbers) + b" ", dtype=np.uint8)
        code = text.astype(np.uint64)
        code = (code[:-2] << np.uint64(16)) | (code[1:-1] << np.uint64(8)) | code[2:]
        inside = text[1:-1] != 32
        self.byte_at = (np.cumsum(text == 32)[1:-1] - 1)[inside]  # the word that each belongs to
        self.bytes = mix(code[inside] + MIX[3]) >> shift
        self.grams = np.bincount(self.byte_at, minlength=n) + 1
        self.buckets = buckets

    def counts(self) -> np.ndarray:
        often = np.bincount(self.flat, minlength=len(self.word)).astype(np.float64)
        return (np.bincount(self.bytes.astype(np.int64), weights=often[self.byte_at], minlength=self.buckets)
                + np.bincount(self.word.astype(np.int64), weights=often, minlength=self.buckets))

    def per_text(self, of_word: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(of_word[self.flat])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def scores(self, ratio: np.ndarray) -> np.ndarray:
        of_word = np.bincount(self.byte_at, weights=ratio[self.bytes.astype(np.int64)], minlength=len(self.word)) + ratio[self.word.astype(np.int64)]
        return self.per_text(of_word) / np.maximum(self.per_text(self.grams.astype(np.float64)), 1)


def _count(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket over every row; tasks add up their own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets)
        for b in batches:
            for (part,) in slices(b, 0):
                total += Slice(map(words_of, part), buckets).counts()
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["bucket", "n"])

    out = np.zeros(buckets)
    for r in texts.mapInArrow(tidied(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, prior: float = PRIOR) -> np.ndarray:
    """Log ratio of target to raw frequency by bucket, shrunk to 0 where the target should hold few by chance.

    The target is at most target_rows documents with label quality 1 and toxic not 1, those with the smallest hash of
    their id; the raw counts are of every document. Without labelled documents the target is the corpus itself, so every
    ratio is 0 and only the base rules decide.
    """
    bound_batches(docs.sparkSession)
    trusted = (labels.filter("quality = 1 and coalesce(toxic, 0) <> 1").select(F.col("doc_id").cast("long").alias("_id")).distinct()
               .orderBy(F.xxhash64("_id"), "_id").limit(target_rows))
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("_id"))
    raw = _count(texts.select("text"), buckets)
    target = _count(texts.join(F.broadcast(trusted), "_id", "left_semi").select("text"), buckets)  # at most target_rows ids
    if not target.sum():
        target = raw
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + prior) / (expected + prior))


COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
_ARROW = pa.schema([(n.split()[0], pa.float64() if n.split()[1] == "double" else pa.int64()) for n in COUNTS.split(", ")])


def _repeated(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    at, owner = window_owner(starts, 3)
    covered = np.zeros(len(flat) + 3, dtype=bool)
    if len(at):
        keys = window_hashes(flat.astype(np.uint64), 3)[at] ^ mix(owner.astype(np.uint64) + MIX[3])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        for k in range(3):
            covered[twice + k] = True
    sums = np.concatenate([[0], np.cumsum(covered[:len(flat)])])
    return sums[starts[1:]] - sums[starts[:-1]]


def measure(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and score of every document; a text without words scores 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in slices(b, 1):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                part = Slice((x.split() for x in raw), len(ratio))
                dup = []
                for t in texts:
                    lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
                    dup.append(len(lines) - len(set(lines)))
                yield pa.record_batch([
                    pa.array(ids, pa.int64()), pa.array(np.diff(part.starts)),
                    pa.array([len(t or "") - len(x) + len(x.translate(None, SPACES)) for t, x in zip(texts, raw, strict=True)], pa.int64()),
                    pa.array([len(x) - len(x.translate(None, SYMBOLS)) for x in raw], pa.int64()), pa.array(dup, pa.int64()),
                    pa.array(_repeated(part.flat, part.starts).astype(np.int64)), pa.array(part.scores(ratio))], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidied(run), COUNTS)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """doc_id, counts, score, base_failed, kept for every row of docs.

    base_failed: under 50 words, or over half the words in 3-word windows that the text repeats. kept: not base_failed,
    and a score of at least threshold. A null or empty text has no words and fails; null ids and repeated rows are judged
    as any row; an empty table gives no rows.
    """
    counts = measure(docs, fit_ratio(docs, labels, id_col, text_col, **fit), id_col, text_col)
    return (counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The rows of docs that judge_quality keeps, all their columns unchanged, in one narrow pass."""
    ratio = fit_ratio(docs, labels, id_col, text_col, **fit)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, at):
                s = Slice(map(words_of, part.column(at).to_pylist()), len(ratio))
                n = np.diff(s.starts)
                good = (n >= 50) & (100 * _repeated(s.flat, s.starts) <= 50 * n) & (s.scores(ratio) >= threshold)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(tidied(run), docs.schema)
