"""N-gram Jaccard join: a grouped prefix join of shingle sets, and its classes.

A document's set holds the hashes of its runs of ``k`` words. Documents with equal sets are one class. Two classes are
linked when their Jaccard similarity is at least ``num / den``.

Order and prefixes. Shingles are ordered by the number of classes that have them, then by hash. Of two similar sets
each must have one of its first ``n - ceil(num * n / den) + 1`` shingles in common with the other (prefix filter). A
shingle that only one class has cannot be common, so a class whose prefix consists of such ones is done; for the
others only repeated shingles are kept, which are all that an intersection can hold.

Counting. Chunks of documents send sorted shingle hashes with their classes to ranges of the hashes, a packed row
each. There are at most 2 ** ``FAN_BITS`` ranges; where that is too few for the volume, the rows that so many chunks sent
to a range are merged and sent on to as many parts of it. So rows are in proportion to bytes, at any volume, at the price
of one more exchange beyond 64 GiB of text. A shingle that many classes of a chunk have, or of a merged row, goes on as a
mark only; its classes go elsewhere, chunk by chunk, and it counts as the most frequent. So no range gathers the documents
of a hot shingle.

Join. Classes with the same prefix and size are collapsed into one group. Every member is verified against the group's
first; those that are not similar to it become groups of their own. For each prefix shingle the groups that have it are
verified against its first group (length filter, then intersection); what is linked becomes one component. Where groups
of different components still share a prefix shingle, their pairs are filtered (length, position) and their first members
verified; only groups that then still belong to different components are expanded into pairs of members and verified.
Links within a component need no further proof, links between components are all found, so the components are exact,
and a large family of near copies costs about as many checks as it has members.

Edge cases: null and empty texts, and texts without words, have empty sets and are linked with nothing; a text of fewer
than ``k`` words is one shingle; repeated rows and null keys are kept, the component of a null key that is linked with no
key is null; ties in the order are broken by hash; other columns pass through in ``join`` and are ignored before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import give_back, pieces, small_batches, stash, text_bytes, trim, unstash
from ._words import BY_SPACE, Words, shingles
from .components import components
from .lm import packed, unpacked

CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Bits of a hash by which a row is split at once: 4096 ranges, and as many chunks whose rows are merged.
FAN_BITS = 12
#: A shingle is heavy in a chunk if at least this share of its classes, and this many, have it; in a merged row, from so many on.
HEAVY_SHARE, HEAVY_LEAST, HEAVY_MERGED = 1 / 32, 32, 1024
HEAVY_COUNT = (1 << 31) - 1
#: Rounds of leaders before the remaining pairs are listed.
STAR_ROUNDS = 2


def sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = Words(texts, BY_SPACE)
    every = shingles(words.hashes, k)
    out = []
    for a, b in zip(words.cuts[:-1].tolist(), words.cuts[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(every[a : b - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(shingles(words.hashes[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def class_id(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def classes(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``cls`` (a number for its set) and ``n_shingles``."""
    keep = [c for c in docs.columns if c not in (text, "cls", "n_shingles")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, CHUNK_BYTES):
            found = sets(text_bytes(batch.column(text)), k)
            made = [pa.array([class_id(s) for s in found], type=pa.int64()), pa.array([len(s) for s in found], type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "cls", "n_shingles"])
        give_back()

    return docs.mapInArrow(run, f"{fields}, cls bigint, n_shingles bigint")


#: Sorted hashes with the numbers of their owners, marks of heavy shingles; ids and sizes of the owners. ``apart`` rows hold
#: the heavy shingles of a chunk and are left alone.
SENT = "bucket bigint, chunk bigint, apart boolean, hashes binary, owners binary, heavy binary, ids binary, sizes binary"
KINDS = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(KINDS)], names=[c.split()[0] for c in SENT.split(", ")])


def _ranges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of the top ``bits`` begins among sorted hashes, and where the last ends."""
    return np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _split(hashes: np.ndarray, owners: np.ndarray, ids: np.ndarray, sizes: np.ndarray, marks: np.ndarray, heavy_from: float, chunk: int, bits: int, base: int, more: int) -> list[tuple]:
    """Rows for the ranges of ``bits + more`` top bits, of hashes that agree in the first ``bits`` (``base``): sorted hashes and
    their owners' numbers in ``ids`` and ``sizes``. Heavy shingles leave a mark and go into a row of their own."""
    opens = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(opens, len(hashes)))
    is_heavy = times >= heavy_from
    apart = np.repeat(is_heavy, times)
    out: list[tuple] = []

    def row(bucket: int, heavy: bool, own: np.ndarray, of: np.ndarray, left: np.ndarray) -> None:
        here, number = np.unique(of, return_inverse=True)
        out.append((bucket, chunk, heavy, packed(own), number.astype(np.uint32).tobytes(), packed(left), ids[here].tobytes(), sizes[here].tobytes()))

    if apart.any():
        row(-1 - base, True, hashes[apart], owners[apart], hashes[:0])
        marks = np.unique(np.concatenate((marks, hashes[opens[is_heavy]])))
        hashes, owners = hashes[~apart], owners[~apart]
    keep = np.uint64((1 << (64 - bits)) - 1)
    cuts, mark_cuts = (_ranges((h & keep) << np.uint64(bits), more) for h in (hashes, marks))
    for b in np.flatnonzero(np.diff(cuts) + np.diff(mark_cuts)).tolist():
        row((base << more) + b, False, hashes[cuts[b] : cuts[b + 1]], owners[cuts[b] : cuts[b + 1]], marks[mark_cuts[b] : mark_cuts[b + 1]])
    return out


def _send(k: int, text: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, CHUNK_BYTES):
            distinct = {class_id(s): s for s in sets(text_bytes(batch.column(text)), k) if len(s)}
            if not distinct:
                continue
            ids = np.array(list(distinct), dtype=np.int64)
            sizes = np.array([len(s) for s in distinct.values()], dtype=np.uint32)
            hashes = np.concatenate(list(distinct.values()))
            owners = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            order = np.argsort(hashes, kind="stable")
            chunk = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=7).digest(), "little")
            yield _rows(_split(hashes[order], owners[order], ids, sizes, hashes[:0], max(HEAVY_LEAST, HEAVY_SHARE * len(ids)), chunk, 0, 0, bits))
            del distinct, hashes, owners, order
            give_back()

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes with the classes that have them and those classes' sizes, sorted and distinct, and all marks."""
    hashes = np.concatenate([unpacked(r["hashes"]) for r in rows])
    numbers = [np.frombuffer(r["owners"], dtype=np.uint32) for r in rows]
    owner = np.concatenate([np.frombuffer(r["ids"], dtype=np.int64)[k] for r, k in zip(rows, numbers, strict=True)])
    size = np.concatenate([np.frombuffer(r["sizes"], dtype=np.uint32)[k] for r, k in zip(rows, numbers, strict=True)])
    order = np.lexsort((owner, hashes))
    hashes, owner, size = hashes[order], owner[order], size[order]
    if len(hashes):
        fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        hashes, owner, size = hashes[fresh], owner[fresh], size[fresh]
    return hashes, owner, size, np.unique(np.concatenate([unpacked(r["heavy"]) for r in rows]))


def _send_on(bits: int, more: int):
    """Of the rows of a range and a group of chunks: rows for ranges ``more`` bits narrower."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows[0]["apart"]:
            return table.select([c.split()[0] for c in SENT.split(", ")])
        hashes, owner, size, marks = _merged(rows)
        ids, first, number = np.unique(owner, return_index=True, return_inverse=True)
        made = _split(hashes, number.astype(np.uint32), ids, size[first], marks, HEAVY_MERGED, rows[0]["chunk"], bits, rows[0]["bucket"], more)
        return pa.Table.from_batches([_rows(made)])

    return run


REPEATED = "cls bigint, n int, shingle bigint, times int"


def _repeated(table: pa.Table) -> pa.Table:
    """Of a range's shingles, or the heavy ones of a chunk: those that several classes have, with each of these."""
    found = _repeats(table.to_pylist())
    trim()  # the worker waits for other stages, beside a heap that later ones need
    return found


def _repeats(rows: list[dict]) -> pa.Table:
    hashes, owner, size, marks = _merged(rows)
    if rows[0]["apart"]:
        times = np.full(len(hashes), HEAVY_COUNT)
    else:
        _, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
        times = np.where(np.isin(hashes, marks), HEAVY_COUNT, n[at]) if len(hashes) else np.zeros(0)
    kept = times > 1
    columns = (pa.array(owner[kept]), pa.array(size[kept].astype(np.int32)), pa.array(hashes[kept].view(np.int64)), pa.array(times[kept].astype(np.int32)))
    return pa.table(list(columns), names=["cls", "n", "shingle", "times"])


def _needed(n: Column, num: int, den: int) -> Column:
    """ceil(num * n / den): the least overlap of a set of ``n`` with any that is similar."""
    return F.floor((n * num + den - 1) / den)


def candidates(docs: DataFrame, k: int, num: int, den: int, text: str = "text") -> DataFrame:
    """Classes that may be linked: ``cls``, ``n``, ``tokens`` (repeated shingles, the rarest first) and ``m``, how many of
    them belong to the prefix."""
    volume = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    bits = max(4, (-(-volume // BUCKET_BYTES) - 1).bit_length())
    done = min(bits, FAN_BITS)
    sent = docs.select(text).mapInArrow(_send(k, text, done), SENT)
    while done < bits:
        more = min(bits - done, FAN_BITS)
        groups = max(1, volume // CHUNK_BYTES >> FAN_BITS)
        grouped = sent.withColumn("chunk", F.when(F.col("apart"), F.col("chunk")).otherwise(F.pmod("chunk", F.lit(groups))))
        sent = grouped.groupBy("bucket", "chunk").applyInArrow(_send_on(done, more), SENT)
        done += more
    # rows of heavy shingles stay by themselves, chunk by chunk
    repeated = sent.withColumn("chunk", F.when(F.col("apart"), F.col("chunk"))).groupBy("bucket", "chunk").applyInArrow(_repeated, REPEATED)
    gathered = repeated.groupBy("cls", "n").agg(F.collect_set(F.struct("times", "shingle")).alias("own"))
    prefix = F.col("n") - _needed(F.col("n"), num, den) + 1
    m = (prefix - (F.col("n") - F.size("own"))).cast("int")
    return gathered.withColumn("m", m).where("m > 0").select("cls", "n", F.transform(F.array_sort("own"), lambda s: s["shingle"]).alias("tokens"), "m")


def _similar(a: str, b: str, num: int, den: int) -> Column:
    both = F.size(F.array_intersect(f"{a}_tokens", f"{b}_tokens"))
    return both * den >= (F.col(f"{a}_n") + F.col(f"{b}_n") - both) * num


def _verified(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar."""
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("cls").alias(side), F.col("n").alias(f"{side}_n"), F.col("tokens").alias(f"{side}_tokens")), side)
    return pairs.where(_similar("a", "b", num, den)).select("a", "b")


def _labelled(table: DataFrame, node: str, comps: DataFrame) -> DataFrame:
    """``table`` with ``comp``: the component of ``node``, or itself."""
    known = comps.select(F.col("node").alias(node), F.col("component"))
    return table.join(known, node, "left").withColumn("comp", F.coalesce("component", node)).drop("component")


def links(known: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links (a, b) between classes that connect all that is similar, their components (node, component), and the written
    tables that both are made of."""
    kept: list[DataFrame] = []
    rows = known.count()  # what follows has some rows for each class

    def write(df: DataFrame, label: str) -> DataFrame:
        kept.append(stash(df, f"join-{label}", rows))
        return kept[-1]

    grouped = known.withColumn("gid", F.xxhash64("n", F.slice("tokens", 1, F.col("m"))))
    firsts = write(grouped.groupBy("gid").agg(F.min("cls").alias("first"), F.count("*").alias("size")).where("size > 1"), "groups")
    member = grouped.select("gid", "cls").join(firsts, "gid").where("cls != first").select(F.col("first").alias("a"), F.col("cls").alias("b"))
    inside = write(_verified(member, known, num, den), "inside")
    groups = known.join(inside.select(F.col("b").alias("cls")), "cls", "left_anti")
    prefix = F.slice("tokens", 1, F.col("m"))
    every = groups.select("cls", "n", F.size("tokens").alias("common"), F.posexplode(prefix).alias("at", "token"))
    every = write(every.select("token", F.col("cls").alias("rep"), "n", "common", "at"), "places")
    shared = write(every.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "shared")
    places = write(every.join(shared, "token"), "places")

    # what both have in common is at least this, and at most the repeated shingles of either
    least = F.floor(((F.col("a_n") + F.col("b_n")) * num + num + den - 1) / (num + den))
    fits = (F.col("a_n") * den >= F.col("b_n") * num) & (F.col("b_n") * den >= F.col("a_n") * num) & (F.least("a_common", "b_common") >= least)
    def connected(found: DataFrame) -> DataFrame:
        kept.append(components(found, rows=rows))
        return kept[-1]

    found = inside
    comps = connected(found)
    for turn in range(STAR_ROUNDS):
        now = write(_labelled(places, "rep", comps), "labelled")
        # first the group with the smallest share of shingles of its own, which is likeliest to be what others were made of
        own = F.floor((F.col("n") - F.col("common")) * 1000 / F.col("n")).cast("bigint")
        order = F.struct(F.xxhash64(F.lit(turn), "rep").alias("h") if turn else own.alias("h"), "rep", "n", "common", "comp")
        leaders = now.groupBy("token").agg(F.min(order).alias("l"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
        leaders = write(leaders.select("token", F.col("l.rep").alias("a"), F.col("l.n").alias("a_n"), F.col("l.common").alias("a_common"), F.col("l.comp").alias("a_comp")), "leaders")
        if leaders.isEmpty():
            return found, comps, kept
        pairs = now.join(leaders, "token").where("comp != a_comp").withColumns({"b_n": F.col("n"), "b_common": F.col("common")}).where(fits).select("a", F.col("rep").alias("b")).distinct()
        new = write(_verified(pairs, known, num, den), "star")
        if new.isEmpty():
            break
        found = found.unionByName(new)
        comps = connected(found)
    # pairs of groups of different components that share a prefix shingle
    now = write(_labelled(places, "rep", comps), "labelled")
    mixed = write(now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("token"), "mixed")
    left = write(now.join(mixed, "token"), "left")
    one, two = (left.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "n", "common", "at", "comp"))) for s in ("a", "b"))
    # at the first shingle that both prefixes have, what follows bounds the overlap, since none before it is common; a pair
    # that the bound rules out there is not similar, and at later shingles the bound is only tighter
    room = F.least(F.col("a_common") - F.col("a_at"), F.col("b_common") - F.col("b_at"))
    pairs = one.join(two, "token").where("a_rep < b_rep and a_comp != b_comp").where(fits).where(room >= least).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()
    pairs = write(pairs, "pairs")
    new = write(_verified(pairs, known, num, den), "rest")
    if not new.isEmpty():
        found = found.unionByName(new)
        comps = connected(found)
    # members of groups that are still apart; a group of one has been verified
    several = inside.select(F.col("a").alias("rep"), F.col("b").alias("cls"))
    if not (pairs.isEmpty() or several.isEmpty()):
        standing = several.unionByName(several.select("rep", F.col("rep").alias("cls")).distinct())
        apart = pairs
        for side in ("a", "b"):
            apart = _labelled(apart, side, comps).withColumnRenamed("comp", f"{side}_comp")
        apart = apart.where("a_comp != b_comp").select("a", "b")
        for side in ("a", "b"):
            own = standing.select(F.col("rep").alias(side), F.col("cls").alias(f"{side}_cls"))
            apart = apart.join(own, side, "left").withColumn(f"{side}_cls", F.coalesce(f"{side}_cls", side))
        apart = apart.where("a_cls != a or b_cls != b").select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))
        new = write(_verified(apart, known, num, den), "members")
        if not new.isEmpty():
            found = found.unionByName(new)
            comps = connected(found)
    return found, comps, kept


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_shingles``, ``component`` (a class that stands for all that links lead to; null
    for empty sets) and ``component_id`` (the smallest key there)."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("cls", "n_shingles", "component", "component_id")]
    coded = stash(classes(docs.select(*others), k, text), "join-classes")
    known = stash(candidates(docs.select(text), k, num, den, text), "join-known")
    _, comps, kept = links(known, num, den)
    members = coded.where("n_shingles > 0").groupBy("cls").agg(F.min(key).alias("least"))
    rows = docs.count()
    labelled = stash(_labelled(members, "cls", comps), "join-members", rows)
    unstash(known, *kept)
    lowest = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    whole = stash(labelled.join(lowest, "comp").select("cls", F.col("comp").alias("component"), "component_id"), "join-components", rows)
    unstash(labelled)
    out = coded.join(whole, "cls", "left")
    return out.select(*[c for c in others if c != text], "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))
