"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters are good.

The sort key of a row is a triple of 64-bit numbers: the hash of its text, the hash of its id, and, for rows that are equal
in both and together too large for the tolerance or for one task, a number of their own, else 0. So equal texts lie
together and yet any group of them can be cut. All rows are counted (bytes below each of 4096 equally
spaced boundaries), partition by partition and summed. For each of the splitters the interval that holds its
target is found; only rows in those intervals are counted again, below boundaries 4096 times as dense, until a
boundary comes within the tolerance of the target, or the key has no more digits. Then rows are exchanged once, by shard and
by a part of the shard, to be numbered.

What comes to the driver is bounded: 4096 counts for each splitter and round, and for each shard. Everything is DataFrame
functions. Numbers of equal rows are drawn once and written with the rows, so that a lost executor changes none.

Edge cases: a null text has no bytes (size 1, the crc32 of no bytes) and null ids have a hash like any other; equal texts are
in one shard unless a boundary falls among them; with fewer keys than shards some shards are empty; an empty table has no
rows; columns named as the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import stash, unstash

#: Bits of the key that a round adds: 4096 probes in each interval that is open.
BITS = 12
#: Rows of a part of a shard, which one task numbers.
PART_ROWS = 100_000
KEY_BITS = 64
KEYS = ("key_1", "key_2", "key_3")
#: Keys of many equal rows that are sent to all executors, 16 bytes each.
MOST_SENT = 500_000


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus one), ``text_crc32`` and the sort key, the third number of which is 0."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        "*", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), raw).alias("key_1"), F.xxhash64(F.lit(2), F.col(key)).alias("key_2"), F.lit(0).cast("long").alias("key_3"),
    )


def _digit(level: int) -> Column:
    """The ``level``-th group of bits of the key, from the top; the last group of each number is shorter."""
    groups = -(-KEY_BITS // BITS)
    column = F.col(KEYS[level // groups])
    k = level % groups
    low = max(0, KEY_BITS - (k + 1) * BITS)
    width = min(BITS, KEY_BITS - k * BITS)
    return F.shiftrightunsigned(column, low).bitwiseAND((1 << width) - 1)


LEVELS = len(KEYS) * -(-KEY_BITS // BITS)


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002) -> list[tuple[int, ...]]:
    """``shards - 1`` boundaries, ascending: groups of key bits; a row belongs below a boundary if its own groups are
    lexicographically smaller. ``tolerance``: of a shard's share of all bytes."""
    bytes_and_rows = (F.sum("size").alias("n"), F.count("*").alias("rows"))
    counts = [(int(d), int(n), int(r)) for d, n, r in rows.groupBy(_digit(0).alias("d")).agg(*bytes_and_rows).collect()]
    total = sum(n for _, n, _ in counts)
    allowed = tolerance * total / shards
    out: dict[int, tuple[int, ...]] = {}
    # an open interval: its prefix -> bytes below it, bytes and rows of its cells, and the splitters that look in it
    open_cells: dict[tuple[int, ...], tuple[int, list[tuple[int, int, int]], list[int]]] = {(): (0, sorted(counts), list(range(1, shards)))}
    for level in range(LEVELS):
        following: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for prefix, (below, cells, wanting) in open_cells.items():
            for s in wanting:
                target, at = total * s / shards, below
                for digit, n, r in cells:
                    if at + n >= target:
                        break
                    at += n
                else:
                    digit, n, r = (cells[-1][0], 0, 0) if cells else (0, 0, 0)
                    out[s] = (*prefix, digit + 1)
                    continue
                if target - at <= allowed:
                    out[s] = (*prefix, digit)
                elif at + n - target <= allowed:
                    out[s] = (*prefix, digit + 1)
                elif level == LEVELS - 1 or r == 1:  # nothing is left to cut
                    out[s] = (*prefix, digit if target - at <= at + n - target else digit + 1)
                else:
                    place = following.setdefault((*prefix, digit), (at, []))
                    place[1].append(s)
        if not following:
            break
        level += 1
        digits = [_digit(k).alias(f"d{k}") for k in range(level + 1)]
        inside = rows.select("size", *digits).where(F.struct(*(f"d{k}" for k in range(level))).isin([F.struct(*(F.lit(d).cast("long") for d in p)) for p in following]))
        cells_of: dict[tuple[int, ...], list[tuple[int, int, int]]] = {p: [] for p in following}
        for r in inside.groupBy(*(f"d{k}" for k in range(level + 1))).agg(*bytes_and_rows).collect():
            cells_of[tuple(int(r[f"d{k}"]) for k in range(level))].append((int(r[f"d{level}"]), int(r["n"]), int(r["rows"])))
        open_cells = {p: (below, sorted(cells_of[p]), wanting) for p, (below, wanting) in following.items()}
    return [out[s] for s in range(1, shards)] if total else [(0,)] * (shards - 1)


def _reaches(boundary: tuple[int, ...]) -> Column:
    """Whether a row's key is at or above ``boundary``."""
    out: Column = F.lit(True)
    for k in reversed(range(len(boundary))):
        d = _digit(k)
        out = (d > boundary[k]) | ((d == boundary[k]) & out)
    return out


def _told_apart(rows: DataFrame, narrow: DataFrame, allowed: float) -> tuple[DataFrame, DataFrame]:
    """Both tables with a third number for rows that are equal in text and id, where those of a key are more than
    ``allowed`` bytes or than a part may have."""
    times = narrow.groupBy("key_1", "key_2").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    many = stash(times.where(f"n > 1 and (bytes > {allowed} or n > {PART_ROWS})").select("key_1", "key_2"), "shard-equal")
    n = many.count()
    if not n:
        return rows, narrow
    few = F.broadcast(many) if n <= MOST_SENT else many
    own = F.xxhash64(F.monotonically_increasing_id(), F.rand())
    apart = stash(rows.join(few, ["key_1", "key_2"], "left_semi").withColumn("key_3", own), "shard-apart")
    rows = rows.join(few, ["key_1", "key_2"], "left_anti").unionByName(apart)
    narrow = narrow.join(few, ["key_1", "key_2"], "left_anti").unionByName(apart.select(*narrow.columns))
    return rows, narrow


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (its number in the shard, from 0)."""
    names = [f.name for f in docs.schema.fields if f.name not in ("size", "text_crc32", *KEYS, "shard", "slot")]
    rows = keyed(docs.select(*names), key, text)
    keys = stash(rows.select("size", *KEYS), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    rows, narrow = _told_apart(rows, keys, tolerance * total / shards)
    boundaries = splitters(narrow, shards, tolerance)

    def placed(df: DataFrame) -> DataFrame:
        number = F.lit(0)
        for b in boundaries:
            number = number + _reaches(b).cast("int")
        return df.withColumns({"shard": number, "part": _digit(0)})

    # parts of a shard: by the first digit of the key, and where that has too many rows, by a hash of the whole key
    spark = docs.sparkSession
    coarse = placed(narrow)
    counts = [(int(s), int(p), int(n)) for s, p, n in coarse.groupBy("shard", "part").agg(F.count("*")).collect()]
    most = max(1, min(PART_ROWS, sum(n for *_, n in counts) >> (BITS - 2)))
    # 4096 parts and those that boundaries cut: bounded by the number of shards
    pieces = F.broadcast(spark.createDataFrame([(s, p, -(-n // most)) for s, p, n in counts], T.StructType.fromDDL("shard int, part bigint, pieces bigint")))

    def cut(df: DataFrame) -> DataFrame:
        mixed = F.shiftrightunsigned(F.xxhash64(*KEYS), 32)
        return df.join(pieces, ["shard", "part"]).withColumn("sub", F.shiftrightunsigned(mixed * F.col("pieces"), 32))

    # where each part begins in its shard: a row for a few thousand parts, and one more for each PART_ROWS rows
    before = Window.partitionBy("shard").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(coarse).groupBy("shard", "part", "sub").agg(F.count("*").alias("n"))
    firsts = stash(sizes.select("shard", "part", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot")), "shard-parts")
    unstash(keys)
    within = Window.partitionBy("shard", "part", "sub").orderBy(*KEYS, "size", "text_crc32")
    numbered = cut(placed(rows)).withColumn("nth", F.row_number().over(within) - 1)
    joined = numbered.join(firsts, ["shard", "part", "sub"])
    return joined.select(*names, "size", "text_crc32", "shard", (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"))
