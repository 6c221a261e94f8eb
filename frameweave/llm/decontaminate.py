"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every item gives windows of ``size`` consecutive words (an item of fewer words is one window). A window's shingles of
three words are ordered by their counts over all documents. A document contains a window only if it contains all of
its shingles, so the rarest one is the prefix that has to be joined. Where a document has that shingle, the window's
place follows from the shingle's place in it (positional bound), must lie within the document's words (length bound),
and its words are then compared, byte by byte.

Items come in blocks of bounded size, each sent to all executors as a few arrays. Shingles are counted for several blocks
in one scan. A larger benchmark is more blocks; documents go through them one after the other without being shuffled,
and between blocks they are written, so that one block at a time is in memory. Only a document's text goes to Python.

Edge cases: null and empty texts have no words, neither hits nor windows; items without an id are left out, ids may have
any simple type; equal items under several ids all count; the texts of an id that occurs more than once all count for it.
Documents are kept one to one, repeated or not, and other columns pass through; without items nothing is hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._io import give_back, pieces, small_batches, stash, text_bytes, unstash
from ._words import BY_SIGNS, Words, shingles

SIZE, SHINGLE = 10, 3
#: Bytes of items in a block (the bound of what is broadcast at once), and blocks whose shingles are counted in one scan.
BLOCK_BYTES, COUNTED_TOGETHER = 4 << 20, 8
BATCH_BYTES = 2 << 20


@dataclass
class Windows:
    """The distinct windows of a block: ``data[begin:end]`` has a window's words with a blank between them, ``words`` their
    number, ``owners`` the items that have it. ``tokens[cuts[i]:cuts[i + 1]]`` are the shingles of the i-th, in its order."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    words: np.ndarray
    owners: list[tuple]
    tokens: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, items: list[tuple], size: int) -> Windows:
        parts, spans, owners, tokens, at = [], [], [], [], 0
        known: dict[bytes, int] = {}
        for item, text in items:
            words = Words([text], BY_SIGNS)
            n = len(words.hashes)
            if not n:
                continue
            flat = b" ".join(words.word(i) for i in range(n))
            ends = np.cumsum(words.ends - words.starts + 1) - 1
            starts = ends - (words.ends - words.starts)
            few = min(n, size)
            width = min(SHINGLE, few)
            own = shingles(words.hashes, width)
            for i in range(n - few + 1):
                a, b = int(starts[i]), int(ends[i + few - 1])
                k = known.setdefault(flat[a:b], len(owners))
                if k == len(owners):
                    spans.append((at + a, at + b, few))
                    owners.append({item})
                    tokens.append(own[i : i + few - width + 1])
                else:
                    owners[k].add(item)
            parts.append(flat)
            at += len(flat)
        begin, end, words_of = (np.array([s[j] for s in spans], dtype=np.int64) for j in range(3))
        cuts = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        return cls(b"".join(parts), begin, end, words_of, [tuple(o) for o in owners], np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), cuts)

    def widths(self) -> np.ndarray:
        return np.minimum(self.words, SHINGLE)


def _runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``size`` words that lie within one text, and their first words."""
    of = words.of_text()
    found = shingles(words.hashes, size)
    own = np.flatnonzero(of[: len(found)] == of[size - 1 :]) if len(found) else np.zeros(0, dtype=np.int64)
    return found[own], own


def _counts(docs: DataFrame, text: str, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of the known shingles (by size, sorted) occurs in all of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        totals = {k: np.zeros(len(v), dtype=np.int64) for k, v in wanted.items()}
        for batch in pieces(batches, text, BATCH_BYTES):
            words = Words(text_bytes(batch.column(text)), BY_SIGNS)
            for k, keys in wanted.items():
                found, _ = _runs(words, k)
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                totals[k] += np.bincount(at[keys[at] == found], minlength=len(keys))
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at), pa.array(n[at])], names=["size", "at", "n"])
        give_back()

    out = {k: np.zeros(len(v), dtype=np.int64) for k, v in known.items()}
    if known:
        # as many rows as the blocks have shingles, at most
        for size, at, n in docs.select(text).mapInArrow(run, "size int, at bigint, n bigint").groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
            out[size][at] = n
    sent.unpersist()
    return out


@dataclass
class Index:
    """A block's windows by their rarest shingles: for each size of shingle the sorted keys, and beside each key its
    window's number and the shingle's place in it."""

    windows: Windows
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, windows: Windows, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Index:
        by_size = {}
        widths = windows.widths()
        window = np.repeat(np.arange(len(widths)), np.diff(windows.cuts))
        for size, (known, totals) in counts.items():
            own = np.flatnonzero(widths[window] == size)
            if not len(own):
                continue
            n = totals[np.searchsorted(known, windows.tokens[own])]
            order = own[np.lexsort((windows.tokens[own], n, window[own]))]
            first = order[np.concatenate(([True], np.diff(window[order]) > 0))]
            n_first = totals[np.searchsorted(known, windows.tokens[first])]
            first = first[n_first > 0]  # a shingle that no document has rules its window out
            if len(first):
                first = first[np.argsort(windows.tokens[first], kind="stable")]
                by_size[size] = (windows.tokens[first], window[first], first - windows.cuts[window[first]])
        return cls(windows, by_size)

    def find(self, words: Words) -> tuple[dict[int, set], dict[int, list[tuple[int, int]]]]:
        """Items and hit spans (of word numbers) by text."""
        items: defaultdict[int, set] = defaultdict(set)
        spans: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        of, known = words.of_text(), self.windows
        for size, (keys, window, offset) in self.by_size.items():
            found, first = _runs(words, size)
            low = np.searchsorted(keys, found, side="left")
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == found)
            low, times = low[hit], np.searchsorted(keys, found[hit], side="right") - low[hit]
            at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            place = np.repeat(first[hit], times)
            w = window[at]
            begin = place - offset[at]
            text = of[place]
            inside = np.flatnonzero((begin >= words.cuts[text]) & (begin + known.words[w] <= words.cuts[text + 1]))
            for b, k, t in zip(begin[inside].tolist(), w[inside].tolist(), text[inside].tolist(), strict=True):
                n = int(known.words[k])
                if b" ".join([words.word(i) for i in range(b, b + n)]) == known.data[known.begin[k] : known.end[k]]:
                    items[t].update(known.owners[k])
                    spans[t].append((b - int(words.cuts[t]), b - int(words.cuts[t]) + n))
        return items, spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


NEW = ("n_words", "hit_spans", "hit_items")
SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (of word numbers, disjoint, the end excluded) and ``hit_items``."""
    small_batches(docs.sparkSession)
    kind = benchmark.schema[item].dataType
    known = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    volume = known.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-int(volume) // BLOCK_BYTES) or 1
    out, written = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in NEW)), None
    for start in range(0, blocks, COUNTED_TOGETHER):
        numbers = range(start, min(blocks, start + COUNTED_TOGETHER))
        # a block at a time: of bounded size, here and in every worker
        parts = [Windows.of([(i, t.encode()) for i, t in known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()], size) for k in numbers]
        every = {w: [p.tokens[np.repeat(p.widths(), np.diff(p.cuts)) == w] for p in parts] for w in range(1, SHINGLE + 1)}
        shingles_of = {w: np.unique(np.concatenate(t)) for w, t in every.items()}
        shingles_of = {w: t for w, t in shingles_of.items() if len(t)}
        totals = _counts(docs, text, shingles_of)
        for k, part in zip(numbers, parts, strict=True):
            out = _pass(out, Index.of(part, {w: (shingles_of[w], totals[w]) for w in shingles_of}), text, kind, k > 0)
            if k + 1 < blocks:
                before, out = written, stash(out, "decontaminated")
                written = out
                if before is not None:
                    unstash(before)
    return out


def _pass(docs: DataFrame, index: Index, text: str, kind: T.DataType, again: bool) -> DataFrame:
    """The documents with what one block hits, beside what those before it did."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    arrow = to_arrow_type(kind)
    schema = T.StructType([*T.StructType.fromDDL("n_words bigint, hit_spans array<struct<a:bigint,b:bigint>>").fields, T.StructField("hit_items", T.ArrayType(kind))])

    def hits(column: pa.Array, before: list[tuple[list, list]] | None) -> pa.Array:
        out: list[list] = [[], [], []]
        at = 0
        for part in pieces([pa.RecordBatch.from_arrays([column], names=["text"])], "text", BATCH_BYTES):
            words = Words(text_bytes(part.column(0)), BY_SIGNS)
            items, spans = sent.value.find(words)
            out[0] += words.counts().tolist()
            for i in range(part.num_rows):
                s, e = spans.get(i, []), items.get(i, set())
                if before:
                    s, e = s + [(x["a"], x["b"]) for x in before[0][at + i]], e | set(before[1][at + i])
                out[1].append([{"a": a, "b": b} for a, b in merged(s)])
                out[2].append(sorted(e))
            at += part.num_rows
        kinds = (pa.int64(), SPANS, pa.list_(arrow))
        return pa.StructArray.from_arrays([pa.array(v, type=t) for v, t in zip(out, kinds, strict=True)], names=list(NEW))

    def first(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield hits(column, None)
        give_back()

    def more(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, spans, items in columns:
            yield hits(column, (spans.to_pylist(), items.to_pylist()))
        give_back()

    others = [F.col(f"`{c}`") for c in docs.columns if c not in NEW]
    asked = [F.col(f"`{text}`"), F.col("hit_spans"), F.col("hit_items")] if again else [F.col(f"`{text}`")]
    found = F.arrow_udf(more if again else first, schema).asNondeterministic()(*asked)
    taken = "found" + "_" * max((len(c) for c in docs.columns), default=0)  # no other column's name
    return docs.select(*others, found.alias(taken)).select(*others, *(F.col(taken).getField(n).alias(n) for n in NEW))
