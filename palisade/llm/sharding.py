"""Sharding by histogram sort.

Rows are put in the order of (hash of the text, id), so copies of a text lie side by side. Candidate boundaries
("probes") cut the key space; one aggregation a round counts the exact bytes and rows between them, and the next round
sets finer probes only where a shard boundary is still off by more than the tolerance. Then rows are exchanged once, by
range. Besides the shard boundaries there is a target for each 64 MB (range_bytes) of the input, by which slots are
numbered in parallel; beyond MOST_RANGES of them ranges grow instead, so whatever the input's size the driver holds at
most about MOST_CELLS cells a round and the broadcast splitters are at most MOST_RANGES + shards.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.sources.scratch import cut

FIRST_BITS, STEP_BITS = 12, 8
MOST_RANGES, MOST_CELLS = 1 << 16, 1 << 20
BLOCK = 128  # splitters of one cell are searched in blocks of so many


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _bits_of(column: str, kept: int) -> Column:
    return F.col(column) if kept == 64 else F.shiftright(F.col(column), 64 - kept)


def _as_table(keys: DataFrame, rows: list[dict], fields: str) -> DataFrame:
    """Rows known to the driver, as a table."""
    return keys.sparkSession.sql(f"select inline(from_json(:rows, 'array<struct<{fields}>>'))", args={"rows": json.dumps(rows)})


def _count(keys: DataFrame, column: str, kept: int, cells: DataFrame | None, group: list[str]) -> list:
    """Bytes and rows by the first `kept` bits of a column; of keys in `cells` only, if given."""
    if cells is not None:
        keys = keys.join(F.broadcast(cells), cells.columns)  # at most one cell a target
    out = keys.groupBy(*group, _bits_of(column, kept).alias("cell")).agg(
        F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
        F.min("_hi").alias("hi0"), F.max("_hi").alias("hi1"), F.min("_lo").alias("lo0"), F.max("_lo").alias("lo1"))
    return out.collect()


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, range_bytes: int) -> tuple[list, list]:
    """keys: _hi, _lo, _size. Returns splitters (hi, lo, bytes below, rows below, shard boundary?) in order, and totals."""
    first_bits = FIRST_BITS
    first = sorted(_count(keys, "_hi", first_bits, None, []), key=lambda r: r["cell"])
    total, rows = sum(r["bytes"] for r in first), sum(r["rows"] for r in first)
    range_bytes = max(range_bytes, total // MOST_RANGES)
    per_shard = max(1, -(-total // (n_shards * range_bytes)))
    if n_shards * per_shard * 8 > 1 << first_bits:  # cells of an eighth of a range settle most of the targets at once
        first_bits = (n_shards * per_shard * 8 - 1).bit_length()
        first = sorted(_count(keys, "_hi", first_bits, None, []), key=lambda r: r["cell"])
    wanted = [total * i / (n_shards * per_shard) for i in range(1, n_shards * per_shard)]
    allowed = tolerance * total / n_shards
    least = -(2**63)

    # an edge is (hi, lo, bytes below, rows below); a cell lies between two edges
    def edges(cells: list, start: tuple[int, int], low) -> list:
        at_bytes, at_rows = start
        out = []
        for r in cells:
            out.append((*low(r), at_bytes, at_rows))
            at_bytes, at_rows = at_bytes + r["bytes"], at_rows + r["rows"]
        return [*out, (None, None, at_bytes, at_rows)]

    done: dict[int, tuple] = {}
    open_cells: dict[tuple, list[int]] = {}
    seen: dict[tuple, tuple] = {}

    def settle(targets: list[int], cells: list, marks: list, kind, tail: tuple | None) -> None:
        """Choose an edge for each target, or open the cell that holds it."""
        k = 0
        for i in targets:
            while k + 1 < len(cells) and marks[k + 1][2] <= wanted[i]:
                k += 1
            low, high = marks[k], marks[k + 1] if marks[k + 1][0] is not None else tail
            near = [e for e in (low, high) if e]
            best = min(near, key=lambda e: abs(e[2] - wanted[i]))
            r = cells[k]
            whole = (r["hi0"], r["lo0"]) == (r["hi1"], r["lo1"])
            exact = (i + 1) % per_shard == 0
            if whole or abs(best[2] - wanted[i]) <= (allowed if exact else range_bytes / 4):
                done[i] = best
            else:
                key = kind(r)
                open_cells.setdefault(key, []).append(i)
                seen[key] = (low, high)

    if not first:
        return [], [0, 0]
    end = (None, None, total, rows)
    settle(list(range(len(wanted))), first, edges(first, (0, 0), lambda r: (r["cell"] << (64 - first_bits), least)), lambda r: _next_cell(r, "_hi", first_bits, r["cell"]), end)
    while open_cells:
        now, open_cells = open_cells, {}
        held, seen = seen, {}
        for column, kept in sorted({k[:2] for k in now}):
            some = {k: v for k, v in now.items() if k[:2] == (column, kept)}
            step = max(1, min(STEP_BITS, (MOST_CELLS // len(some)).bit_length() - 1))
            more = min(64, kept + step)
            if column == "_hi":
                cells = _as_table(keys, [{"_cell": k[3]} for k in some], "_cell: bigint")
                found = _count(keys.withColumn("_cell", _bits_of("_hi", kept)), "_hi", more, cells, [])
                owner = lambda r: ("_hi", kept, None, r["cell"] >> (more - kept))  # noqa: B023, E731
            else:
                cells = _as_table(keys, [{"_hi": k[2], "_cell": k[3] if kept else 0} for k in some], "_hi: bigint, _cell: bigint")
                found = _count(keys.withColumn("_cell", _bits_of("_lo", kept) if kept else F.lit(0).cast("long")), "_lo", more, cells, ["_hi"])
                owner = lambda r: ("_lo", kept, r["_hi"], (r["cell"] >> (more - kept)) if kept else None)  # noqa: B023, E731
            by: dict[tuple, list] = {k: [] for k in some}
            for r in found:
                by[owner(r)].append(r)
            for k, cells in by.items():
                cells.sort(key=lambda r: r["cell"])
                low, high = held[k]
                shape = (lambda r: (r["cell"] << (64 - more), least)) if column == "_hi" else (lambda r: (r["_hi"], r["cell"] << (64 - more)))  # noqa: B023
                marks = edges(cells, (low[2], low[3]), shape)
                marks[0] = low
                settle(some[k], cells, marks, lambda r: _next_cell(r, column, more, r["cell"]), high)  # noqa: B023
    out = [(*done[i], (i + 1) % per_shard == 0) for i in range(len(wanted))]
    return out, [per_shard, rows]


def _next_cell(r, column: str, kept: int, cell: int) -> tuple:
    """What to refine: bits of the hash while hashes differ, then, for one text, the bits in which its ids differ."""
    if column == "_hi" and r["hi0"] != r["hi1"]:
        return ("_hi", kept, None, cell)
    low, high = r["lo0"], r["lo1"]
    same = 64 - (low ^ high).bit_length() if (low < 0) == (high < 0) else 0
    same -= same % STEP_BITS
    same = max(same, kept if column == "_lo" else 0)
    return ("_lo", same, r["hi0"], low >> (64 - same) if same else None)


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, range_bytes: int = 64 << 20) -> DataFrame:
    """Each row of docs with shard (int) and slot (long, gapless from 0 in its shard).

    Law: the shards' bytes (UTF-8 of the text, plus 1 a row) differ from equal ones by at most tolerance x a shard's share,
    or by one row where a row is larger than that. A null text has 1 byte; a null id comes first among copies.
    Repeated rows (same text and id) share a key and so a shard; among them slots are dealt in any order.
    An empty table gives an empty result. Further columns pass unchanged, but for shard and slot, which are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot").withColumns({
        "_size": text_bytes(F.col(text_col)) + 1,
        "_hi": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        "_lo": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))})
    keys = cut(docs.select("_hi", "_lo", "_size"), "shard-keys")
    splitters, (per_shard, _) = find_splitters(keys, n_shards, tolerance, range_bytes)
    rows_below = [0, *(s[3] for s in splitters)]
    edges = [(s[0], s[1]) if s[0] is not None else None for s in splitters]
    spans = [rows_below[i] - rows_below[i - i % max(1, per_shard)] for i in range(len(rows_below))]

    # the first round's cells, with how many splitters lie below each and which lie in it
    within: dict[int, list] = {}
    for e in edges:
        if e is not None:
            within.setdefault(e[0] >> (64 - FIRST_BITS), []).append({"hi": e[0], "lo": e[1]})
    cells, below = [], 0
    half = 1 << (FIRST_BITS - 1)
    for cell in range(-half, half):
        own = within.get(cell, [])
        cells.append({"c": cell, "b": below, "s": own, "t": own[::BLOCK]})
        below += len(own)
    table = _as_table(keys, cells, "c: bigint, b: int, s: array<struct<hi: bigint, lo: bigint>>, t: array<struct<hi: bigint, lo: bigint>>")
    passed = lambda x: f"size(filter({x}, x -> x.hi < _hi or (x.hi = _hi and x.lo <= _lo)))"
    at_block = f"{passed('_t')} - 1"  # the last block whose first splitter lies below the row
    inside = f"if({passed('_t')} = 0, 0, ({at_block}) * {BLOCK} + {passed(f'slice(_s, ({at_block}) * {BLOCK} + 1, {BLOCK})')})"
    out = (docs.withColumn("_c", F.shiftright("_hi", 64 - FIRST_BITS))
           .join(F.broadcast(table.select(F.col("c").alias("_c"), F.col("b").alias("_b"), F.col("s").alias("_s"), F.col("t").alias("_t"))), "_c")
           .withColumn("_range", F.col("_b") + F.expr(inside)))
    before = F.from_json(F.lit(json.dumps(spans)), "array<bigint>")
    place = F.row_number().over(W.partitionBy("_range").orderBy("_hi", "_lo"))
    return (out.withColumn("_place", place)
            .withColumn("shard", F.floor(F.col("_range") / max(1, per_shard)).cast("int"))
            .withColumn("slot", (F.element_at(before, F.col("_range") + 1) + F.col("_place") - 1).cast("long"))
            .drop("_size", "_hi", "_lo", "_c", "_b", "_s", "_t", "_range", "_place"))
