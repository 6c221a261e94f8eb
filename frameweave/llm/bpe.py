"""Byte-level BPE: encoding by merge replay over batches, and decoding.

``encode`` cuts every text with the tokenizer's pattern, gathers the distinct pieces of a batch of documents
and replays the merges over all of them together: an inverted index holds, for each rank, the positions at
which the pair of that rank stands. The lowest rank of the index is taken, all its positions are merged at
once, and only the pairs of the touched neighbours are looked up again and filed under their new ranks. Because
pieces are independent of each other and the lowest rank comes first, every piece gets the merges that a
piece-by-piece encoder would give it, in the same order.

This departs from a corpus-level replay with an index from token pairs: merges are replayed inside each batch of
``BATCH_BYTES``, over the pieces that the worker doesn't remember from earlier ones, and the index goes by rank. The
ids are the same; pieces common to several workers are encoded by each, and in return neither the pieces nor their
ids are shuffled.

A merge can bring forth a pair of a lower rank than its own. Where that happens in a piece that had further
positions of the same rank, the order inside the piece would matter; such pieces are encoded once more on their own.

Edge cases: a null or empty text has no ids and decodes to no bytes; equal texts get equal ids; rows are
kept one to one, repeated or not; columns other than the text and the new ones pass through unread. The vocabulary
file's path is a parameter; the file is read by whoever makes the query and sent to the workers.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import give_back, pieces, small_batches, text_bytes, trim

#: Distinct units that a worker remembers between batches; then it starts anew. A bound on memory, not on results.
REMEMBERED = 200_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 2 << 20
#: Pairs whose ranks are looked up at once at the start; each takes several 64-bit numbers.
LOOKED_UP = 1 << 16


class MergeReplay:
    """The ranks of a vocabulary, and the replay of its merges over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.width
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(values, dtype=np.int64)[order]
        self.first = dict(zip(keys, values, strict=True))

    @classmethod
    def from_bytes(cls, file: bytes) -> MergeReplay:
        """Of a file with a token in base 64 and its rank in each line."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())})

    @classmethod
    def from_file(cls, path: str) -> MergeReplay:
        return cls.from_bytes(_read(path))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where the vocabulary has none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_one(self, piece: bytes) -> list[int]:
        """The plain greedy rule for one piece: lowest rank first, then leftmost."""
        ids = [int(self.byte_ids[b]) for b in piece]
        ranks = [self.first.get(a * self.width + b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        while True:
            best = min((r for r in ranks if r >= 0), default=-1)
            if best < 0:
                return ids
            i = ranks.index(best)
            ids[i : i + 2] = [best]
            ranks[i : i + 1] = []
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    ranks[j] = self.first.get(ids[j] * self.width + ids[j + 1], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of every piece as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1])
        tok = self.byte_ids.astype(np.int32)[np.frombuffer(b"".join(words), dtype=np.uint8)]
        of_word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after = np.arange(1, total + 1)
        before = np.arange(-1, total - 1)
        after[ends[sizes > 0] - 1] = -1
        before[starts[sizes > 0]] = -1
        alive = np.ones(total, dtype=bool)
        rank = np.full(total, -1, dtype=np.int32)  # of the pair that starts here
        has = np.flatnonzero(after >= 0)
        for begin in range(0, len(has), LOOKED_UP):
            at = has[begin : begin + LOOKED_UP]
            rank[at] = self.rank_of(tok[at], tok[at + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: set[int] = set()

        def file(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                heads, groups = r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at]
            else:
                heads, groups = [int(r[0])], [at]
            for k, g in zip(heads, groups, strict=True):
                if k in index:
                    index[k].append(g)
                else:
                    index[k] = [g]
                    heapq.heappush(heap, k)

        file(has)
        while heap:
            now = heapq.heappop(heap)
            held = index.pop(now)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[rank[at] == now]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                touch = after[at[:-1]] == at[1:]
                if touch.any():  # as in "aaa": the leftmost of a run, then every other one
                    place = np.arange(len(at))
                    opens = np.concatenate(([True], ~touch))
                    at = at[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            tok[at] = now
            alive[gone] = False
            rank[gone] = -1
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            rank[at] = -1
            left = before[at]
            changed = np.concatenate((at[inner], left[left >= 0]))
            if len(changed):
                new = self.rank_of(tok[changed], tok[after[changed]])
                rank[changed] = new
                low = changed[(new >= 0) & (new < now)]
                if len(low):
                    many = of_word[at]
                    several = {int(w) for w, n in zip(*np.unique(many, return_counts=True), strict=True) if n > 1}
                    odd.update(w for w in of_word[low].tolist() if w in several)
                file(changed)
        counts = np.bincount(of_word[alive], minlength=len(words)) * 4
        stops = np.cumsum(counts).tolist()
        ids = tok[alive].astype("<u4").tobytes()
        out, begin = [], 0
        for stop in stops:
            out.append(ids[begin:stop])
            begin = stop
        for w in odd:
            out[w] = np.array(self.encode_one(words[w]), dtype="<u4").tobytes()
        return out


@lru_cache(maxsize=1)
def _replay(file: bytes) -> MergeReplay:
    return MergeReplay.from_bytes(file)


class _Units:
    """Numbered strings with their ids; each stands for itself with ``lead`` before it."""

    def __init__(self, lead: str) -> None:
        self.lead = lead
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.ends, self.uneven = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=bool)

    def numbers(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, parts), dtype=np.int32, count=len(parts))

    def learn(self, replay: MergeReplay, cut) -> None:
        """Encode the units that are new."""
        new = list(islice(self.number, len(self.uneven), None))
        if not new:
            return
        pieces_of: defaultdict[str, int] = defaultdict()
        pieces_of.default_factory = pieces_of.__len__
        lead, piece = self.lead, pieces_of.__getitem__
        at = [list(map(piece, cut(lead + u))) for u in new]
        ids = replay.encode([p.encode() for p in pieces_of])
        joined = [ids[i[0]] if len(i) == 1 else b"".join([ids[k] for k in i]) for i in at]
        sizes = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)) // 4
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(joined), dtype="<u4")))
        self.uneven = np.concatenate((self.uneven, np.fromiter((not u or u[0].isspace() or u[-1].isspace() for u in new), dtype=bool, count=len(new))))

    def ids(self, n: np.ndarray) -> bytes:
        begin, end = self.ends[n], self.ends[n + 1]
        sizes = end - begin
        stop = np.cumsum(sizes)
        return self.flat[np.repeat(end - stop, sizes) + np.arange(stop[-1] if len(stop) else 0)].tobytes()


class Encoder:
    """Encodes texts with a remembered vocabulary of units.

    A unit is what stands between two single spaces, with the space before it. Where a space has no white space
    beside it, the usual patterns always end a match before it, so units can be cut and encoded on their own; a text with
    other runs of white space has the pattern's own matches as its units, as has every text if the pattern doesn't part
    probes of all kinds of characters there.
    """

    PROBES = ("a", "Zé", "word", "it's", "x1", "12", "!", "--", "。", "日本", "😀", "\u0301", "_", "'s", "a.b", "\u200b")

    def __init__(self, replay: MergeReplay, pattern: str) -> None:
        import regex

        self.replay = replay
        self.cut = regex.compile(pattern).findall
        self.parts = all(self.cut(f"{a} {b}") == self.cut(a) + self.cut(f" {b}") for a in self.PROBES for b in self.PROBES)
        self.forget()

    def forget(self) -> None:
        self.spaced, self.plain = _Units(" "), _Units("")

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced.number) + len(self.plain.number) > REMEMBERED:
            self.forget()
        if not self.parts:
            whole = [self.plain.numbers(self.cut(t)) for t in texts]
            self.learn()
            return [self.plain.ids(n) for n in whole]
        split = [t.split(" ") if t else None for t in texts]
        heads = [self.plain.numbers(s[:1]) if s else None for s in split]
        tails = [self.spaced.numbers(s[1:]) if s else None for s in split]
        del split
        self.learn()
        whole = {}
        for i, t in enumerate(texts):
            if t and (self.plain.uneven[heads[i]].any() or self.spaced.uneven[tails[i]].any()):
                whole[i] = self.plain.numbers(self.cut(t))
        self.learn()
        return [b"" if not t else self.plain.ids(whole[i]) if i in whole else self.plain.ids(heads[i]) + self.spaced.ids(tails[i]) for i, t in enumerate(texts)]

    def learn(self) -> None:
        for units in (self.plain, self.spaced):
            units.learn(self.replay, self.cut)


def _with(df: DataFrame, of: str, names: list[str], make) -> DataFrame:
    """``df`` with binary columns ``names`` that ``make()`` computes from column ``of``, batch by batch. The other columns
    wait beside the worker and are not sent to it."""
    small_batches(df.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # what is made of a piece goes before the next one comes, and free memory with it: an executor's heap and what its
        # workers hold are under one limit, and pieces and vocabularies leave holes of all sizes
        apply = make()
        for column in columns:
            for piece in pieces([pa.RecordBatch.from_arrays([column], names=["of"])], "of", BATCH_BYTES):
                made = [pa.array(x, type=pa.binary()) for x in apply(piece.column(0))]
                trim()
                yield pa.StructArray.from_arrays(made, names=names)
                del made
        del apply
        give_back()

    schema = T.StructType([T.StructField(n, T.BinaryType()) for n in names])
    coded = F.arrow_udf(run, schema)(F.col(f"`{of}`"))
    others = [c for c in df.columns if c not in names]
    taken = "coded" + "_" * max((len(c) for c in others), default=0)  # no other column's name
    return df.select(*(F.col(f"`{c}`") for c in others), coded.alias(taken)).select(*(F.col(f"`{c}`") for c in others), *(F.col(taken).getField(n).alias(n) for n in names))


def _read(ranks_path: str) -> bytes:
    """The vocabulary file, read where the query is made; workers get its bytes."""
    with open(ranks_path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the binary column ``ids``: token ids of ``text`` as little-endian unsigned 32-bit integers."""
    file = df.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def make():
        encoder = Encoder(_replay(file.value), pattern)
        return lambda column: [encoder.texts([t or "" for t in column.to_pylist()])]

    return _with(df, text, [ids], make)


def _decoder(replay: MergeReplay):
    tokens = replay.tokens
    return lambda coded: [b"".join([tokens[i] for i in np.frombuffer(x, dtype="<u4").tolist()]) for x in coded]


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the binary column ``decoded``: the bytes that ``ids`` stand for. Null ids are no ids."""
    file = df.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def make():
        apply = _decoder(_replay(file.value))
        return lambda column: [apply(text_bytes(column))]

    return _with(df, ids, [decoded], make)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with both: the ids of ``text``, and the bytes that those ids decode to; one worker does both."""
    file = df.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def make():
        encoder = Encoder(_replay(file.value), pattern)
        apply = _decoder(encoder.replay)

        def both(column: pa.Array) -> list[list[bytes]]:
            coded = encoder.texts([t or "" for t in column.to_pylist()])
            return [coded, apply(coded)]

        return both

    return _with(df, text, [ids, decoded], make)
