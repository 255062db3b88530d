"""Best-fit packing of token pieces into sequences of a fixed capacity.

Where a piece goes depends on its length alone, so the plan is made from the histogram of lengths: pieces above a third
of the capacity lie at most two in a sequence and are matched greedily (each, from the longest, with the longest that
still fits beside it); shorter ones, from the longest, go to the smallest gap that holds them. The plan is a list of
runs "ranks r.. of length l go to sequences s.. at offset o", a few thousand whatever the input; pieces then find their
place by their rank among pieces of their length.
"""

import functools
import json
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.sources import scratch
from palisade.llm.words import bound_batches, slices, tidied

CAPACITY, END_ID = 1024, 2

# ---------------------------------------------------------------- tokens


# Fixed value: how byte-level vocabularies split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}


def byte_ranks(path: str) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary file and their ids."""
    char = byte_chars()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data["added_tokens"]}
    return {bytes(char[c] for c in word): n for word, n in data["model"]["vocab"].items() if word not in special}


def _split_by_rank(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The word's bytes after all merges of lower ranks, lowest first."""
    held = [word[i:i + 1] for i in range(len(word))]
    while len(held) > 1:
        n, i = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(held, held[1:], strict=False)))
        if n >= below:
            break
        held[i:i + 2] = [held[i] + held[i + 1]]
    return held


@functools.cache
def agrees(path: str) -> bool:
    """Is merging by rank, after splitting by SPLIT, sure to give the ids of the file's own tokenizer?

    So it is if the file is a plain byte-level model; if its merges stand in the order of their results' ids, and each
    result's bytes, merged by lower ranks only, come to just the pair that the merge names (then no other pair can ever
    meet); and if every character is of the same class to both splitters: each of the planes that have any (0 to 3 and the
    start of 14) is put between a letter and a digit.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, split = data["model"], data.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
             and data.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True))
    if not plain:
        return False
    ranks, char = byte_ranks(path), byte_chars()
    last = -1
    for merge in model["merges"]:
        a, b = (bytes(char[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        n = ranks.get(a + b, -1)
        if n <= last or _split_by_rank(a + b, ranks, n) != [a, b]:
            return False
        last = n
    if any(bytes([x]) not in ranks for x in range(256)) or len(ranks) != 256 + len(model["merges"]):
        return False
    own, merged = Tokenizer.from_file(path), tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    own.encode_special_tokens = True
    codes = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
    texts = ["".join(f"x{chr(c)}1" for c in codes[k:k + 4096]) for k in range(0, len(codes), 4096)]
    return all(own.encode(t, add_special_tokens=False).ids == merged.encode_ordinary(t) for t in texts)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, remembered by word.

    Before " x" (x a letter, digit or ASCII mark) after a non-space the vocabulary always splits, so texts whose spaces
    are all of that kind are put together from remembered words; other texts are encoded whole. New words are merged by
    the file's ranks, where `agrees` holds; elsewhere the file's own tokenizer encodes all. A text of every slice is also
    given to that tokenizer; should the two ever differ, it encodes the slice.
    """

    PLAIN = re.compile(r"[!-~]|[^\W_]")

    def __init__(self, path: str, remember: int = 200_000, by_rank: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_rank = by_rank
        if not by_rank:
            return
        ranks = byte_ranks(path)
        self.merge = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for word, n in ranks.items():
            self.sizes[n] = len(word)
        self.held: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.remember = remember

    def by_file(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.merge(text), dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_rank:
            return self.by_file(texts)
        if len(self.held) > self.remember:
            self.held.clear()
            self.odd.clear()
        held, plain = self.held, self.PLAIN.match
        parts = [t.split(" ") for t in texts]
        new = set().union(*parts).difference(held)
        fresh = [x for x in new if plain(x)]
        self.odd.update(x for x in new if not plain(x))
        if fresh:  # encoded together, then cut where the words' bytes end
            ids = np.array(self.merge(" " + " ".join(fresh)), dtype="<u4")
            ends = np.cumsum([len(x.encode()) + 1 for x in fresh])
            data, cuts = ids.tobytes(), (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
            for x, a, z in zip(fresh, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                held[x] = data[a:z]
        look, odd = held.__getitem__, self.odd
        out = [self._whole(t) if odd and not odd.isdisjoint(p) else self._whole(p[0]) + b"".join(map(look, p[1:])) for t, p in zip(texts, parts, strict=True)]
        for x in new:
            if len(x) > 60:
                held.pop(x, None)
        k = min(range(len(texts)), key=lambda i: (len(texts[i]) < 50, len(texts[i])), default=0)
        return out if not texts or self.by_file([texts[k]])[0] == out[k] else self.by_file(texts)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_sizes(n: int, capacity: int) -> list[int]:
    """Only what is longer than the capacity is cut; the first piece may be shorter."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (with end_id after the last): doc_id, piece, start, length, ids_crc32, and ids if asked."""
    by_rank = agrees(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer_path, by_rank=by_rank), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for ids, texts in slices(b, 1, 1 << 20):
                rows = []
                for doc, data in zip(ids, encode([t or "" for t in texts]), strict=True):
                    data, start = data + end, 0
                    for k, n in enumerate(piece_sizes(len(data) // 4, capacity)):
                        own = data[4 * start:4 * (start + n)]
                        rows.append((doc, k, start, n, zlib.crc32(own), *([np.frombuffer(own, "<u4")] if with_ids else [])))
                        start += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidied(run), PIECES + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- plan


class _Gaps:
    """Runs of sequences with the same gap: gap -> [(first sequence, how many)]."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, n: int) -> None:
        if gap not in self.runs:
            self.sizes.insert(bisect_left(self.sizes, gap), gap)
            self.runs[gap] = []
        self.runs[gap].append((first, n))

    def least(self, size: int) -> int | None:
        k = bisect_left(self.sizes, size)
        return self.sizes[k] if k < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, n = self.runs[gap].pop()
        if n > most:
            self.runs[gap].append((first + most, n - most))
            n = most
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.remove(gap)
        return first, n


def plan_packing(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """counts[l]: pieces of length l. Runs (length, first rank, how many, first sequence, offset)."""
    left, rank, out, gaps, sequences = list(counts) + [0] * (capacity + 1 - len(counts)), [0] * (capacity + 1), [], _Gaps(), 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    if left[0]:
        raise ValueError("a piece has at least one token")
    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a] and b > third:
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                put(a, n, sequences, 0)
                put(b, n, sequences, a)
                gaps.add(capacity - a - b, sequences, n)
                sequences += n
            b -= 1
        if left[a]:
            gaps.add(capacity - a, sequences, left[a])
            n = left[a]
            put(a, n, sequences, 0)
            sequences += n
    for s in range(third, 0, -1):
        while left[s]:
            gap = gaps.least(s)
            if gap is None:
                n = -(-left[s] // (capacity // s))
                gaps.add(capacity, sequences, n)
                sequences += n
                gap = capacity
            first, n = gaps.take(gap, left[s])
            put(s, n, first, capacity - gap)
            gaps.add(gap - s, first, n)
    return out


# ---------------------------------------------------------------- places


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 1_000_000, most_salts: int = 256) -> DataFrame:
    """pieces (a table that reads the same each time) with sequence_id and offset.

    Pieces of a length are ranked by (salt, doc_id, piece): the salt, from a hash of the piece, splits lengths that very
    many pieces share, and the driver gets counts of at most capacity x most_salts groups.
    """
    salts = int(min(most_salts, 1 + pieces.count() // rows_per_salt))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    base = np.zeros((capacity + 1, salts + 1), dtype=np.int64)
    for r in pieces.groupBy("length", "_salt").count().collect():
        base[r["length"], r["_salt"] + 1] = r["count"]
    counts = base.sum(axis=1)
    base = np.cumsum(base, axis=1)
    runs = sorted(plan_packing(counts.tolist(), capacity))
    length, rank, _, sequence, offset = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    keys = (length << 44) + rank
    ranked = pieces.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")).cast("long") - 1)
    names = [f.name for f in ranked.schema.fields]
    n_at, s_at, r_at = names.index("length"), names.index("_salt"), names.index("_rank")
    keep = [k for k, n in enumerate(names) if not n.startswith("_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(n_at).to_numpy()
            place = b.column(r_at).to_numpy() + base[own, b.column(s_at).to_numpy()]
            k = np.searchsorted(keys, (own << 44) + place, side="right") - 1
            yield pa.record_batch([*(b.column(i) for i in keep), pa.array(sequence[k] + place - rank[k]), pa.array(offset[k])], [*(names[i] for i in keep), "sequence_id", "offset"])

    shape = ", ".join(f"{names[i]} {ranked.schema[names[i]].dataType.simpleString()}" for i in keep)
    return ranked.mapInArrow(tidied(run), shape + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked) of every piece of every document.

    A null or empty text is one piece, end_id alone. Repeated rows are packed each on its own, null ids too; an empty
    table gives no rows. Further columns of docs are dropped.
    """
    bound_batches(docs.sparkSession)
    pieces = scratch.cut(tokenize_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return pack_pieces(pieces, capacity)
