"""N-gram Jaccard join with a token-group matrix.

A document is the set of its word shingles; two link when the sets' Jaccard similarity reaches the threshold.

1. One pass gives each set's size and digest, and one bit for each hashed cell of tokens: do two documents or more hold
   a token of this cell? The bits are the matrix with all documents as one group: they bound from above how many of a
   set's tokens any other set can hold.
2. Equal sets are one (their smallest id stands for all). A set with too few tokens that others can hold links with
   none and is done. Of the others, the tokens that others can hold are put in one order (often-used ones last), and a
   prefix is kept: so many that two sets that link have at least `SHARED` tokens in common within their prefixes.
3. Similar documents become a group: each chooses, of the documents that lead its prefix tokens, the one it shares most
   of them with; chains of choices are a group. Groups are kept in boxes of about `BOX_BYTES`.
4. Boxes whose prefixes have too few tokens in common, or no members of fitting sizes, never meet. Of two boxes that do,
   the smaller one's members become queries to the larger one, box by box, not pair by pair.
5. A box's matrix has a row for each token and a column for each group of `GROUP` similar members: is the token in the
   group's union? The sum of a query's rows bounds its overlap with every member of a group; only groups whose bound
   reaches what the query must share are opened, and their members' overlaps counted exactly.
6. A box gives each of its members that has links a count of them and one label; components come from the labels.

Steps 3 and 4 only decide what meets where: every pair of linking sets meets once, in one box or in two that are paired.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources import scratch
from palisade.operators.components import components
from palisade.llm import sketch
from palisade.llm.words import MIX, WordHashes, bound_batches, flat_hashes, mix, parts, slices, tidied, window_hashes, window_owner, words_of

SHINGLE, PERCENT, SHARED = 4, 85, 8
BOX_BYTES = 1 << 20  # of tokens
GROUP = 16
PART_BYTES = 8 << 20  # of queries to a box, before it is copied to one more task
HOT_POSTINGS = 4096
EXPANDED = 1 << 20
HEAVY_ROWS = 200_000
HEAVY_PER_TASK = 20_000
BROADCAST_IDS = 1_000_000


class Sets:
    """Distinct shingle hashes of each text, sorted within each text."""

    def __init__(self, texts, cache: WordHashes, size: int):
        words = [words_of(t, lower=True) for t in texts]
        flat, starts = flat_hashes(words, cache)
        at, owner = window_owner(starts, size)
        values = window_hashes(flat, size)[at] if len(at) else flat[:0]
        short = [(i, w) for i, w in enumerate(words) if 0 < len(w) < size]
        if short:
            own = [int(window_hashes(np.array([cache[x] for x in w], dtype=np.uint64), len(w))[0] ^ MIX[len(w) % 4]) for _, w in short]
            values, owner = np.concatenate([values, np.array(own, dtype=np.uint64)]), np.concatenate([owner, np.array([i for i, _ in short])])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        if len(values):
            new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
            values, owner = values[new], owner[new]
        self.values, self.owner = values, owner.astype(np.int64)
        self.n = np.bincount(self.owner, minlength=len(words)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)

    def one(self, i: int) -> np.ndarray:
        return self.values[self.starts[i]:self.starts[i + 1]]

    def digest(self, salt: np.uint64) -> np.ndarray:
        """An order-free hash of each set."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.values ^ salt), dtype=np.uint64)])
        return mix(sums[self.starts[1:]] - sums[self.starts[:-1]]).view(np.int64)


def least_overlap(n, percent: int):
    """What a set of n tokens shares at least with any set that it links with."""
    return (percent * n + 99) // 100


SURVEY = "kind int, id long, n long, d1 long, d2 long, cells binary, twice binary"
_SURVEY = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])


def _rows(kind: int, *columns) -> pa.RecordBatch:
    size = len(columns[0])
    arrays = [pa.array(np.full(size, kind, np.int32))]
    for field, column in zip(list(_SURVEY)[1:], (*columns, *[None] * 6), strict=False):
        arrays.append(pa.nulls(size, field.type) if column is None else pa.array(column, field.type))
    return pa.record_batch(arrays, schema=_SURVEY)


def cells_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens + MIX[3]) >> np.uint64(64 - bits)).astype(np.int64)


def survey(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """docs: id, text. Rows of kind 0: each set's size and digest; 1: cells of tokens by chunk (in id); 2: often-used
    tokens (in id) and their counts (in n), at most HEAVY_PER_TASK of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tokens, counts = WordHashes(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            joined = np.concatenate(held)
            held.clear()
            chunk, cells, twice = sketch.packed(joined)
            return _rows(1, chunk, None, None, None, cells, twice)

        for b in batches:
            for ids, texts in slices(b, 1):
                s = Sets(texts, cache, size)
                yield _rows(0, ids, s.n, s.digest(MIX[0]), s.digest(MIX[1]))
                if not len(s.values):
                    continue
                held.append(cells_of(s.values, bits).astype(np.uint32))
                new, often = np.unique(s.values, return_counts=True)
                new, often = new[often > 2], often[often > 2]
                tokens, where = np.unique(np.concatenate([tokens, new]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([counts, often]), minlength=len(tokens)).astype(np.int64)
                if len(tokens) > HEAVY_PER_TASK:
                    top = np.sort(np.argpartition(counts, -HEAVY_PER_TASK)[-HEAVY_PER_TASK:])
                    tokens, counts = tokens[top], counts[top]
                if sum(map(len, held)) > 2 << 20:
                    yield out()
        if held:
            yield out()
        if len(tokens):
            yield _rows(2, tokens.view(np.int64), counts)

    return docs.mapInArrow(tidied(run), SURVEY)


def heavy_tokens(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Often-used tokens and their counts, by token: at most HEAVY_ROWS of what tasks saw most often.

    They only set the order of tokens, which can be any; the better they are, the shorter the lists of postings.
    """
    top = found.filter("kind = 2").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(HEAVY_ROWS)
    rows = sorted((np.int64(r["id"]).view(np.uint64), r["n"]) for r in top.collect())
    return np.array([t for t, _ in rows], dtype=np.uint64), np.array([n for _, n in rows], dtype=np.int64)


def prefix_sets(docs: DataFrame, held, size: int, percent: int, bits: int) -> DataFrame:
    """docs: id, text. id, n, d1, least token, how many tokens are its own, prefix tokens of sets that can link with another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (tokens, counts, bitmap) = WordHashes(), held.value
        for b in batches:
            for ids, texts in slices(b, 1):
                s = Sets(texts, cache, size)
                due = least_overlap(s.n, percent)
                common = sketch.is_set(bitmap, cells_of(s.values, bits))
                n_common = np.bincount(s.owner, weights=common, minlength=len(s.n)).astype(np.int64)
                able = np.flatnonzero((s.n > 0) & (n_common >= due) & np.array([i is not None for i in ids], bool))
                if not len(able):
                    continue
                common &= ((s.n > 0) & (n_common >= due))[s.owner]
                values, owner = s.values[common], s.owner[common]
                often = np.zeros(len(values), np.int64)
                if len(tokens):
                    k = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
                    often = np.where(tokens[k] == values, counts[k], 0)
                order = np.lexsort((values, often, owner))
                values = values[order]
                starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(s.n)))])
                most = n_common - due + np.minimum(SHARED, due)
                d1 = s.digest(MIX[0])
                _, at = _spread(starts[able], (starts[:-1] + most)[able])
                ends = np.concatenate([[0], np.cumsum(most[able])]).astype(np.int32)
                yield pa.record_batch([pa.array([ids[i] for i in able], pa.int64()), pa.array(s.n[able]), pa.array(d1[able]), pa.array(s.values[s.starts[able]].view(np.int64)), pa.array((s.n - n_common)[able]),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(values[at].view(np.int64)))], ["id", "n", "d1", "least", "own", "prefix"])

    return docs.mapInArrow(tidied(run), "id long, n long, d1 long, least long, own long, prefix array<long>")


def postings(sets: DataFrame) -> DataFrame:
    """A row for each prefix token. Without Python: a second worker for each task would stay until the executor idles."""
    return sets.select(F.explode("prefix").alias("token"), "own", "id", "n", "d1", "least")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of the batches, with no run of equal first values cut in two unless it fills batches; sorted input."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1]))
        held = [x[last:] for x in now]
        if last:
            yield tuple(x[:last] for x in now)
    if held is not None:
        yield tuple(held)


def shared_postings(found: DataFrame) -> DataFrame:
    """Postings of tokens that two sets or more hold, each with the lead of its token: the set with the fewest tokens of its
    own, which lies in the middle of its near copies. Streams sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "id", "n", "d1", "least", "lead"]
        before = None  # a run may go on over batches: its token and lead, and its first posting while that is the only one
        for b in batches:
            if not b.num_rows:
                continue
            token, _, ids, *others = (c.to_numpy() for c in b.columns)
            start = np.concatenate([[before is None or token[0] != before[0]], token[1:] != token[:-1]])
            at = np.maximum.accumulate(np.where(start, np.arange(len(token)), -1))
            lead = np.where(at >= 0, ids[at], before[1] if before else 0)
            keep = ~start | np.concatenate([~start[1:], [False]])  # or the next row has the same token
            if before and before[2] is not None and not start[0]:
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (before[0], before[1], *before[2], before[1])], names)
            before = (token[-1], lead[-1], [x[-1] for x in others] if start[-1] else None)
            if keep.any():
                yield pa.record_batch([pa.array(x[keep]) for x in (token, ids, *others, lead)], names)

    return (found.repartition("token").sortWithinPartitions("token", "own", "id")
            .mapInArrow(tidied(run), "token long, id long, n long, d1 long, least long, lead long"))


def choices(shared: DataFrame) -> DataFrame:
    """a, b: each document and the lead that it shares most prefix tokens with; ties go to the smallest id."""
    hits = (shared.filter("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("hits"), F.min("n").alias("n"))
            .filter((F.col("hits") >= SHARED // 2) | (F.col("n") < 2 * SHARED)))
    return hits.groupBy(F.col("id").alias("a")).agg(F.max_by("lead", F.struct("hits", -F.col("lead"))).alias("b"))


def boxes_of(members: DataFrame, percent: int) -> DataFrame:
    """members: id, d1, n, least, grp. id, d1, box, and of the box: low and high (sizes of sets), members, bytes, and due (the
    common prefix tokens that any link of it has).

    A group of more than BOX_BYTES is dealt out by least tokens, so that similar sets stay together, and where many have the
    same least token, also by id.
    """
    sized = members.withColumn("bytes", 8 * F.col("n"))
    cells = sized.groupBy("grp", "least").agg(F.sum("bytes").alias("cell"))
    whole = cells.groupBy("grp").agg(F.sum("cell").alias("whole")).filter(F.col("whole") > BOX_BYTES)
    hot = cells.filter(F.col("cell") > BOX_BYTES)
    near = F.when(F.col("whole").isNull(), 0).otherwise(F.pmod(F.xxhash64("least"), F.ceil(F.col("whole") / BOX_BYTES)))
    salt = F.when(F.col("cell").isNull(), -1).otherwise(F.pmod(F.xxhash64("id", "d1"), F.ceil(F.col("cell") / BOX_BYTES)))
    placed = sized.join(whole, "grp", "left").join(hot, ["grp", "least"], "left").withColumn("box", F.xxhash64("grp", near, salt))
    spans = (placed.groupBy("box").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"))
             .withColumn("due", F.least(F.lit(SHARED), F.floor((percent * F.col("low") + 99) / 100))))
    return placed.select("id", "d1", "box").join(spans, "box")


def box_pairs(shared: DataFrame, boxes: DataFrame, percent: int, block: int = 1 << 18) -> DataFrame:
    """hub, box, bytes: pairs of boxes that can have links between them; the hub is the larger one, bytes are the other's.

    A task holds the boxes of one token, or of two blocks of them where many boxes have a token, and `block` pairs at a time.
    """
    held = shared.select("token", "id", "d1").join(boxes, ["id", "d1"]).select("token", "box", "low", "high", "bytes", "due")
    hot = scratch.cut(shared.groupBy("token").count().filter(F.col("count") > HOT_POSTINGS).select("token", F.ceil(F.col("count") / HOT_POSTINGS).alias("blocks")), "hot")
    if hot.isEmpty():
        dealt = held.withColumns({"key": F.col("token"), "right": F.lit(False), "cross": F.lit(False)})
    else:
        own, other = F.pmod(F.xxhash64("box"), F.col("blocks")), F.col("other")
        few = held.join(hot, "token", "left_anti").withColumns({"key": F.col("token"), "right": F.lit(False), "cross": F.lit(False)})
        many = held.join(hot, "token").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        many = many.withColumns({"key": F.xxhash64("token", F.least(own, other), F.greatest(own, other)), "right": own > other, "cross": own != other})
        dealt = few.unionByName(many.select(*few.columns))
    rows = dealt.select("key", "right", "box", "cross", "low", "high", "bytes", "due")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hub", "box", "bytes", "due", "hits"]
        out: list[np.ndarray] = []

        def merged() -> np.ndarray:
            rows = np.concatenate(out)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            hits = np.add.reduceat(rows[:, 4], new)
            rows = rows[new]
            rows[:, 4] = hits
            return rows

        for key, right, box, cross, low, high, size, due in _runs(batches):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (box[1:] != box[:-1]) | (right[1:] != right[:-1])])
            key, right, box, cross, low, high, size, due = (x[new] for x in (key, right, box, cross, low, high, size, due))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            n = ends - starts
            end = np.repeat(ends, n)
            split = np.repeat(ends - np.add.reduceat(right.astype(np.int64), starts), n)  # where the right block begins
            begin = np.where(cross, split, np.arange(1, len(key) + 1))
            above = np.where(right, 0, end - begin)
            done = np.concatenate([[0], np.cumsum(above)])
            q = 0
            while q < len(key):
                z = max(q + 1, int(np.searchsorted(done, done[q] + block, side="right")) - 1)
                one = np.repeat(np.arange(q, z), above[q:z])
                two = np.arange(len(one)) - (done[one] - done[q]) + begin[one]
                fit = (100 * high[one] >= percent * low[two]) & (100 * high[two] >= percent * low[one])
                one, two = one[fit], two[fit]
                if len(one):
                    swap = (size[one] < size[two]) | ((size[one] == size[two]) & (box[one] > box[two]))
                    one, two = np.where(swap, two, one), np.where(swap, one, two)
                    out.append(np.stack([box[one], box[two], size[two], np.minimum(due[one], due[two]), np.ones(len(one), np.int64)], axis=1))
                    if sum(map(len, out)) > block:
                        out[:] = [merged()]
                        if len(out[0]) > block // 2:
                            yield pa.record_batch([pa.array(out[0][:, k]) for k in range(5)], names)
                            out.clear()
                q = z
        if out:
            rows = merged()
            yield pa.record_batch([pa.array(rows[:, k]) for k in range(5)], names)

    probes = rows.repartition("key").sortWithinPartitions("key", "right", "box").mapInArrow(tidied(run), "hub long, box long, bytes long, due long, hits long")
    return (probes.groupBy("hub", "box").agg(F.sum("hits").alias("hits"), F.first("bytes").alias("bytes"), F.first("due").alias("due"))
            .filter("hits >= due").select("hub", "box", "bytes"))


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of each one's range, and the positions in it."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which] + starts[which]


class Matrix:
    """A box: its tokens against groups of its members, and the members that hold a token."""

    def __init__(self, ids: np.ndarray, digests: np.ndarray, weights: np.ndarray, sets: list[np.ndarray]):
        order = np.argsort(np.array([x[0] for x in sets], np.uint64), kind="stable")
        self.ids, self.digests, self.weights, self.sets = ids[order], digests[order], weights[order], [sets[k] for k in order]
        self.n = np.array([len(x) for x in self.sets], np.int64)
        flat, member = np.concatenate(self.sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.lexsort((member, flat))
        flat, self.member = flat[order], member[order]
        group = self.member // GROUP
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        cell = np.concatenate([[True], new[1:] | (group[1:] != group[:-1])])
        self.cell = np.append(np.flatnonzero(cell), len(flat))  # where a token's members of one group begin
        self.group = group[self.cell[:-1]]
        self.tokens = flat[new]
        self.row = np.append(np.flatnonzero(new[self.cell[:-1]]), len(self.group))  # where a token's cells begin
        self.held = np.diff(np.append(np.flatnonzero(new), len(flat)))
        firsts = np.arange(0, len(sets), GROUP)
        self.low, self.high = np.minimum.reduceat(self.n, firsts), np.maximum.reduceat(self.n, firsts)

    def links(self, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of the queries from a place on: which members each links with, as a table of bools; some queries at a time."""
        n = np.array([len(x) for x in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        at = np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)
        hit = self.tokens[at] == flat
        at, owner = at[hit], owner[hit]
        work = np.cumsum(np.bincount(owner, weights=self.held[at], minlength=len(sets)))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))]).astype(np.int64)
        a, (members, groups) = 0, (len(self.n), len(self.low))
        most = max(1, EXPANDED // members)
        while a < len(sets):
            z = min(a + most, max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + EXPANDED, side="right"))))
            tokens, query, size = at[cuts[a]:cuts[z]], owner[cuts[a]:cuts[z]] - a, n[a:z, None]
            which, cells = _spread(self.row[tokens], self.row[tokens + 1])
            place = query[which] * groups + self.group[cells]
            bound = np.bincount(place, minlength=(z - a) * groups).reshape(z - a, groups)
            opened = (bound >= least_overlap(size, percent)) & (100 * size >= percent * self.low) & (100 * self.high >= percent * size)
            keep = opened.ravel()[place]
            which, cells = query[which[keep]], cells[keep]
            more, entries = _spread(self.cell[cells], self.cell[cells + 1])
            both = np.bincount(which[more] * members + self.member[entries], minlength=(z - a) * members).reshape(z - a, members)
            yield a, (both > 0) & (100 * both >= percent * (size + self.n - both))
            a = z


LINKS = ["id", "d1", "label", "links"]


def _arrays(rows: list[tuple]) -> tuple:
    ids, digests, weights, sets = zip(*rows, strict=True)
    return *(np.array(x, np.int64) for x in (ids, digests, weights)), [np.frombuffer(x, np.uint64) for x in sets]


class Linked:
    """Labels and counts of the links of one box: a label is the id of a member."""

    def __init__(self, box: Matrix):
        self.box, self.label, self.count = box, box.ids.copy(), np.zeros(len(box.ids), np.int64)

    def own(self, percent: int) -> None:
        for a, table in self.box.links(self.box.sets, percent):
            table &= self.box.ids[a:a + len(table), None] != self.box.ids
            self.count[a:a + len(table)] += table @ self.box.weights
            self.merge(table | (np.arange(a, a + len(table))[:, None] == np.arange(len(self.box.ids))))

    def merge(self, table: np.ndarray) -> np.ndarray:
        """Members of one row of the table get one label, and all that had theirs; the rows' labels."""
        most = np.iinfo(np.int64).max
        while True:
            rows = np.where(table, self.label, most).min(axis=1, initial=most)
            least = np.minimum(self.label, np.where(table, rows[:, None], most).min(axis=0, initial=most))
            old, place = np.unique(self.label, return_inverse=True)
            np.minimum.at(old, place, least)
            if (old[place] == self.label).all():
                return rows
            self.label = old[place]

    def queries(self, ids: np.ndarray, digests: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
        for a, table in self.box.links(sets, percent):
            some, heavy = ids[a:a + len(table)], weights[a:a + len(table)]
            table &= some[:, None] != self.box.ids
            linked = table.any(axis=1)
            if linked.any():
                self.count += heavy @ table
                labels = self.merge(table)
                yield pa.record_batch([pa.array(x) for x in (some[linked], digests[a:a + len(table)][linked], labels[linked], (table @ self.box.weights)[linked])], LINKS)

    def done(self) -> Iterator[pa.RecordBatch]:
        some = self.count > 0
        if some.any():
            yield pa.record_batch([pa.array(x[some]) for x in (self.box.ids, self.box.digests, self.label, self.count)], LINKS)


def box_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, d1, label, links for every member of a box that has links: rows of one set add up; members with one label, and a
    label itself, belong together. pairs: hub, box, bytes (a box with itself: of 0 bytes); sets: box, id, d1, weight, set.

    A task holds one hub and about a megabyte of queries at a time; a hub with many queries is copied to several tasks.
    """
    hubs = pairs.groupBy("hub").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / PART_BYTES)).cast("int").alias("parts"))
    queries = (pairs.filter("hub <> box").join(hubs, "hub").withColumn("part", F.pmod(F.xxhash64("box"), F.col("parts")).cast("int"))
               .join(sets, "box").select("hub", "part", F.lit(1).alias("kind"), "id", "d1", "weight", "set"))
    heads = (hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sets.withColumnRenamed("box", "hub"), "hub")
             .select("hub", "part", F.lit(0).alias("kind"), "id", "d1", "weight", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, box, members, seen = None, None, [], None

        def made() -> Linked:
            out = Linked(Matrix(*_arrays(members)))
            if now[1] == 0 and len(members) > 1:
                out.own(percent)
            return out

        for b in batches:
            for piece in parts(b, 6):
                keys = list(zip(*(piece.column(k).to_pylist() for k in range(5)), strict=True))
                rows = list(zip(*(piece.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True))
                a = 0
                while a < len(keys):
                    hub, part, kind, *_ = keys[a]
                    z = a
                    fresh = []
                    while z < len(keys) and keys[z][:3] == (hub, part, kind):
                        if keys[z] != seen:  # else a row that repeats id and text
                            fresh.append(rows[z])
                        seen = keys[z]
                        z += 1
                    if now != (hub, part):
                        if now is not None:
                            box = box or made()
                            yield from box.done()
                        now, box, members = (hub, part), None, []
                    if kind == 0:
                        members += fresh
                    elif fresh:
                        if not members:
                            raise ValueError(f"no sets for the box {hub}")
                        box = box or made()
                        yield from box.queries(*_arrays(fresh), percent)
                    a = z
        if now is not None:
            box = box or made()
            yield from box.done()

    return (heads.unionByName(queries).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "id", "d1")
            .mapInArrow(tidied(run), "id long, d1 long, label long, links long"))


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """docs: id, text, box, d1, weight. The rows whose text has the digest, with the set (8 bytes a token, sorted) for the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for part in parts(b, 1):
                s = Sets(part.column(1).to_pylist(), cache, size)
                same = np.flatnonzero(s.digest(MIX[0]) == part.column(3).to_numpy())
                yield pa.record_batch([*(part.column(k).take(pa.array(same)) for k in (2, 0, 3, 4)), pa.array([s.one(i).tobytes() for i in same], pa.binary())], ["box", "id", "d1", "weight", "set"])

    return docs.select("id", "text", "box", "d1", "weight").mapInArrow(tidied(run), "box long, id long, d1 long, weight long, set binary")


def _bounded(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows; it has been written."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def join_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs.

    Words are runs of anything but ASCII white space, A-Z lowered. A text of fewer than `size` words is one shingle; a
    null or empty one has none, links with nothing and is its own component. n_links counts the other
    documents' texts that a row's text links with, equal ones included. Rows that repeat an id are one document, and its
    component has the links of all its texts. A null id has a null component and no links. Further columns are dropped.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(total / 8)  # about a cell for each word: a set is done if too few of its tokens fall into shared ones
    found = scratch.cut(survey(rows, size, bits), "survey")
    bitmap = sketch.merged(found.filter("kind = 1").select(F.col("id").alias("chunk"), "cells", "twice"), bits)[0]
    held = spark.sparkContext.broadcast((*heavy_tokens(found), bitmap))
    sets = found.filter("kind = 0").select("id", "n", "d1", "d2")
    usable = sets.filter("id is not null and n > 0")
    classes = (usable.distinct().groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")).filter("weight > 1"))
    copies = scratch.cut(usable.distinct().join(classes, ["d1", "d2", "n"]).select("id", "d1", "rep", "weight"), "copies")
    prefixes = prefix_sets(rows, held, size, percent, bits).join(_bounded(copies.filter("id > rep").select("id", "d1")), ["id", "d1"], "left_anti")
    shared = scratch.cut(shared_postings(postings(prefixes)), "shared")
    held.unpersist()

    members = shared.select("id", "d1", "n", "least").distinct()
    members = members.join(components(choices(shared)), "id", "left").withColumn("grp", F.coalesce("component", "id"))
    boxes = scratch.cut(boxes_of(members, percent), "boxes")
    alone = boxes.filter("members > 1").select(F.col("box").alias("hub"), "box", F.lit(0).cast("long").alias("bytes")).distinct()
    pairs = scratch.cut(box_pairs(shared, boxes, percent).unionByName(alone), "pairs")
    wanted = boxes.select("id", "d1", "box").join(pairs.select("hub").union(pairs.select("box")).distinct().withColumnRenamed("hub", "box"), "box", "left_semi")
    weights = copies.filter("id = rep").select("id", "d1", "weight")
    wanted = scratch.cut(wanted.join(weights, ["id", "d1"], "left").select(F.col("id").alias("_id"), "d1", "box", F.coalesce("weight", F.lit(1)).alias("weight")), "wanted")
    texts = rows.join(_bounded(wanted), F.col("id") == F.col("_id"))
    links = scratch.cut(box_links(pairs, scratch.cut(sets_of(texts, size), "sets"), percent), "links")

    often = copies.filter("id > rep").join(usable.select("id", "d1").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "id", "left_semi")
    whole = components(links.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(often.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    counts = links.groupBy(F.col("id").alias("node"), "d1").agg(F.sum("links").alias("links"))
    return (sets.join(copies, ["id", "d1"], "left").withColumn("node", F.coalesce("rep", "id"))
            .join(counts, ["node", "d1"], "left").join(whole.withColumnRenamed("id", "node"), "node", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"),
                    (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links")))


def _all_columns(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component, the one with its smallest id; all columns unchanged.

    Rows without words are all kept but for repeats of an id; rows with a null id are all kept. Of rows that repeat an id,
    the one with the smallest text stays (null first), and of equal ones the one with the smallest hash of all columns.
    An empty table gives an empty one.
    """
    found = scratch.cut(join_near(docs, id_col, text_col, **options), "components")
    gone = scratch.cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    often = scratch.cut(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_often")), "often")
    own = F.col(id_col).cast("long")
    kept = docs.join(_bounded(gone), own == F.col("_gone"), "left_anti")
    if not often.isEmpty():
        often = _bounded(often)
        order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first(), "_hash")
        once = kept.join(often, own == F.col("_often"), "left_semi").withColumn("_hash", _all_columns(docs)).withColumn("_place", F.row_number().over(order))
        kept = kept.join(often, own == F.col("_often"), "left_anti").unionByName(once.filter("_place = 1").select(*(f"`{c}`" for c in docs.columns)))
    return kept
