"""Language-model scoring: word bigrams by deleted interpolation.

The probability of a word after another is a mixture of the bigram's and the word's maximum-likelihood estimates and of
a uniform share for a word never seen. The weights depend on how often the context was seen (a bucket for each
power of two) and are learned by expectation-maximisation: one tenth of the texts is held out, its counts are deleted from
the estimates, and the weights that suit its own counts best are kept. Scoring uses the counts of all training texts.

How counts get to texts without a row for each word: texts are coded in chunks of a few megabytes. A chunk has the hashes
of its distinct words and a stream of word numbers. It sends the sorted hashes of its words and bigrams, with its counts,
to ranges of the hashes, a packed row for each. A range adds the counts up and answers every chunk with the totals in the
order of its hashes. So a frequent word costs one entry for each chunk, whatever the number of its occurrences.

A chunk sends to at most 2 ** ``FAN_BITS`` ranges. Where that is too few for the volume, the rows of so many chunks for
a range are added up first, the sums go on to as many parts of it, and answers come back the same way. So rows are in
proportion to bytes at any volume, and a word that all chunks have is an entry for each of so many chunks only.

Edge cases: a null or empty text is one end token; a null key is a training text; keys may have any simple type; equal texts
have equal scores up to rounding; a text larger than a chunk is a chunk of its own; without training texts the uniform share
is all there is. Rows are kept one to one, repeated or not; of other columns only the key is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import give_back, pieces, small_batches, stash, text_bytes, unstash
from ._words import BY_SPACE, Words, mix

#: Bytes of text in a chunk, and of text for each range of the hashes.
CHUNK_BYTES, RANGE_BYTES = 14 << 20, 16 << 20
#: Bits of a hash by which a row is split at once: 4096 ranges, and as many chunks whose rows are added up.
FAN_BITS = 12
BUCKETS_OF_CONTEXT = 20
END = np.uint64(0x5BD1E9955BD1E995)
STEPS_PER_OCTAVE = 4

#: The keys of a chunk's texts are a record batch in Arrow's own format, so that they may have any type.
CHUNKS = "chunk string, keys binary, folds binary, sizes binary, vocabulary binary, counts binary, stream binary"


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: the high planes of small numbers vanish."""
    size = numbers.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, size).T.tobytes())


def numbers(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


#: First bytes below the first bound are numbers; those below the second have one more byte, the others two.
ONE_BYTE, TWO_BYTES = 192, 240


def dense(words: np.ndarray) -> bytes:
    """Word numbers, the frequent ones small, in one to three bytes each: all first bytes, then what follows them, compressed."""
    limit = ONE_BYTE + (TWO_BYTES - ONE_BYTE) * 256
    if len(words) and int(words.max()) >= limit + (256 - TWO_BYTES) * 65536:
        return b"p" + planes(words.astype(np.uint32))
    two, three = words[(words >= ONE_BYTE) & (words < limit)] - ONE_BYTE, words[words >= limit] - limit
    first = words.copy()
    first[(words >= ONE_BYTE) & (words < limit)] = ONE_BYTE + (two >> 8)
    first[words >= limit] = TWO_BYTES + (three >> 16)
    parts = [x.astype(np.uint8).tobytes() for x in (first, two & 255, three >> 8 & 255, three & 255)]
    head = np.array([len(x) for x in parts], dtype="<u8").tobytes()
    return b"d" + head + zstandard.ZstdCompressor(level=9).compress(b"".join(parts))


def undense(data: bytes) -> np.ndarray:
    if data[:1] == b"p":
        return numbers(data[1:], np.uint32).astype(np.int64)
    ends = np.cumsum(np.frombuffer(data[1:33], dtype="<u8")).tolist()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[33:]), dtype=np.uint8).astype(np.int64)
    first, two, high, low = raw[: ends[0]], raw[ends[0] : ends[1]], raw[ends[1] : ends[2]], raw[ends[2] :]
    out = first.copy()
    limit = ONE_BYTE + (TWO_BYTES - ONE_BYTE) * 256
    second, third = (first >= ONE_BYTE) & (first < TWO_BYTES), first >= TWO_BYTES
    out[second] = ONE_BYTE + ((first[second] - ONE_BYTE) << 8 | two)
    out[third] = limit + ((first[third] - TWO_BYTES) << 16 | high << 8 | low)
    return out


def packed(keys: np.ndarray) -> bytes:
    """64-bit keys by their differences; they are small where keys ascend."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.uint64), dtype=np.uint64)


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut to about ``most`` bytes of ``column``, whatever size they come in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in pieces(batches, column, max(1, most // 8)):
        n = piece.column(column).nbytes
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ipc(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], names=["key"])
    with pa.ipc.new_stream(sink, batch.schema) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of coded texts: distinct word hashes, sorted, with their counts, and the numbers of all words. Words are numbered
    by their counts, the most frequent first, and equal ones by their hashes, so that the numbers needn't be told."""
    for batch in _gathered(batches, "text", CHUNK_BYTES):
        words = Words(text_bytes(batch.column("text")), BY_SPACE)
        counts = words.counts()
        all_words = np.full(len(words.hashes) + len(counts), END, dtype=np.uint64)
        ends = np.cumsum(counts + 1) - 1
        inner = np.ones(len(all_words), dtype=bool)
        inner[ends] = False
        all_words[inner] = words.hashes
        distinct, number, n = np.unique(all_words, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        stream = dense(rank[number].astype(np.int64))
        row = [
            [uuid.uuid4().hex], [_ipc(batch.column("key"))], [batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int8).tobytes()],
            [(counts + 1).astype(np.uint32).tobytes()], [packed(distinct)], [planes(n.astype(np.uint32))], [stream],
        ]
        kinds = (pa.string(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "keys", "folds", "sizes", "vocabulary", "counts", "stream"])
        give_back()


class Coded:
    """The texts of a chunk by numbers: ``word``, ``context`` (the word before; before the first one stands the end of the text
    before) and ``fold`` by token."""

    def __init__(self, row: dict) -> None:
        self.keys = row["keys"]  # read where they are needed
        self.sizes = np.frombuffer(row["sizes"], dtype=np.uint32).astype(np.int64)
        self.fold = np.repeat(np.frombuffer(row["folds"], dtype=np.int8), self.sizes)
        self.word = undense(row["stream"])
        starts = np.cumsum(self.sizes) - self.sizes
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        if len(starts):
            self.context[starts] = self.word[starts + self.sizes - 1]

    def pairs(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of context and word, as numbers in order, and each token's place among them."""
        return np.unique(self.context * words + self.word, return_inverse=True)


class Chunk(Coded):
    """A chunk with the hashes of what it counts: of words ``hashes``, sorted, and their ``rank`` (number); of its pairs
    ``pair_hashes``, in the order of ``pairs``, and ``pair_order``, which sorts them."""

    def __init__(self, row: dict) -> None:
        super().__init__(row)
        self.hashes = unpacked(row["vocabulary"])
        order = np.argsort(-numbers(row["counts"], np.uint32).astype(np.int64), kind="stable")
        self.rank = np.empty_like(order)
        self.rank[order] = np.arange(len(order))
        vocabulary = self.hashes[order]
        distinct, self.pair = self.pairs(len(order))
        before, after = vocabulary[distinct // len(order)], vocabulary[distinct % len(order)]
        self.pair_hashes = mix(before * np.uint64(0x9E3779B97F4A7C15) ^ (after + np.uint64(0x2545F4914F6CDD1D)))
        self.pair_order = np.argsort(self.pair_hashes, kind="stable")


#: A row's hashes are sorted and agree in their first bits, ``range`` (which has them in front of one that tells words, 0, from
#: bigrams, 1); ``chunk`` says who asks.
SENT = "range bigint, chunk string, hashes binary, train binary, nine binary"
SENT_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())


def _table(rows: list[tuple], schema: str, kinds: tuple) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])


def _parts(side: int, base: int, done: int, more: int, chunk: str, keys: np.ndarray, train: np.ndarray, nine: np.ndarray) -> list[tuple]:
    """Rows for the ranges that ``more`` bits after the first ``done`` tell apart."""
    low = (keys >> np.uint64(64 - done - more)) & np.uint64((1 << more) - 1)
    cuts = np.searchsorted(low, np.arange((1 << more) + 1, dtype=np.uint64))
    out = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[b], cuts[b + 1])
        out.append((2 * ((base << more) + b) + side, chunk, packed(keys[own]), planes(train[own]), planes(nine[own])))
    return out


def _send(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row)
                trained, deleted = chunk.fold != 0, chunk.fold == 9
                sides = (
                    (chunk.hashes, *(np.bincount(chunk.word[t], minlength=len(chunk.rank))[chunk.rank] for t in (trained, deleted))),
                    (chunk.pair_hashes[chunk.pair_order], *(np.bincount(chunk.pair[t], minlength=len(chunk.pair_order))[chunk.pair_order] for t in (trained, deleted))),
                )
                for side, (keys, train, nine) in enumerate(sides):
                    made = _parts(side, 0, 0, bits, row["chunk"], keys, train.astype(np.int64), nine.astype(np.int64))
                    yield from _table(made, SENT, SENT_KINDS).to_batches()
                del chunk, sides, made
                give_back()

    return run


ANSWER = "chunk string, range bigint, train binary, nine binary, tokens bigint, types bigint, nine_tokens bigint"
ANSWER_KINDS = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


def _added(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct hashes of rows, the places of each row's hashes among them, and the sums of both counts."""
    keys = [unpacked(r["hashes"]) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("train", "nine"):
        n = np.concatenate([numbers(r[name], np.int64) for r in rows])
        sums.append(np.bincount(at, n, len(distinct)).astype(np.int64))
    return distinct, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), sums


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a range's hashes for everyone who sent some, and a row of sums for words."""
    rows = table.to_pylist()
    _, places, totals = _added(rows)
    here = rows[0]["range"]
    out = [(r["chunk"], here, planes(totals[0][own]), planes(totals[1][own]), None, None, None) for r, own in zip(rows, places, strict=True)]
    if here % 2 == 0:
        out.append(("", here, None, None, int(totals[0].sum()), int((totals[0] > 0).sum()), int(totals[1].sum())))
    return _table(out, ANSWER, ANSWER_KINDS)


def _send_on(done: int, more: int):
    """The sums of a range over a group of chunks, for parts of the range. The group asks under its own name."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        here = rows[0]["range"]
        distinct, _, sums = _added(rows)
        return _table(_parts(here % 2, here // 2, done, more, f"{here} {rows[0]['team']}", distinct, *sums), SENT, SENT_KINDS)

    return run


def _hand_back(sent: pa.Table, answers: pa.Table) -> pa.Table:
    """What a group was answered, for each of its chunks; sums pass through."""
    if not sent.num_rows:
        return answers.select([c.split()[0] for c in ANSWER.split(", ")])
    rows = sent.to_pylist()
    found = sorted(answers.to_pylist(), key=lambda r: r["range"])
    totals = [np.concatenate([numbers(r[name], np.int64) for r in found]) for name in ("train", "nine")]
    _, places, _ = _added(rows)
    return _table([(r["chunk"], r["range"], planes(totals[0][own]), planes(totals[1][own]), None, None, None) for r, own in zip(rows, places, strict=True)], ANSWER, ANSWER_KINDS)


def _answers(sent: DataFrame, done: int, bits: int, teams: int, written: list[DataFrame]) -> DataFrame:
    """The totals for all that is asked in ``sent``, whose ranges have ``done`` of the ``bits`` that ranges need."""
    if done >= bits:
        return sent.groupBy("range").applyInArrow(_answer, ANSWER)
    written.append(stash(sent.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams))), "lm-sent"))
    sent = written[-1]
    more = min(bits - done, FAN_BITS)
    onward = sent.groupBy("range", "team").applyInArrow(_send_on(done, more), SENT)
    answers = _answers(onward, done + more, bits, max(1, teams >> FAN_BITS), written)
    # groups are named "range team"; sums, which no one asked for, have a name without
    named = answers.withColumns({"asked": F.split_part("chunk", F.lit(" "), F.lit(1)).try_cast("bigint"), "team": F.split_part("chunk", F.lit(" "), F.lit(2)).try_cast("bigint")})
    return sent.groupBy("range", "team").cogroup(named.groupBy("asked", "team")).applyInArrow(_hand_back, ANSWER)


#: A chunk with the totals of its words, by number, and of its pairs, in order; hashes aren't needed any more.
COUNTED = "chunk string, keys binary, folds binary, sizes binary, stream binary, word_train binary, word_nine binary, pair_train binary, pair_nine binary, tokens bigint, types bigint, nine_tokens bigint"
COUNTED_KINDS = (pa.string(), *[pa.binary()] * 8, *[pa.int64()] * 3)


def _gather(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk with the totals that it asked for; or the sums that no one asked for."""
    found = sorted(answers.to_pylist(), key=lambda r: r["range"])
    if not chunks.num_rows:
        return _table([(*[None] * 9, *(sum(r[n] for r in found) for n in ("tokens", "types", "nine_tokens")))], COUNTED, COUNTED_KINDS)
    row = chunks.to_pylist()[0]
    chunk = Chunk(row)
    made = [row[n] for n in ("chunk", "keys", "folds", "sizes", "stream")]
    for side, place in ((0, chunk.rank), (1, chunk.pair_order)):
        for name in ("train", "nine"):
            total = np.concatenate([numbers(r[name], np.int64) for r in found if r["range"] % 2 == side])
            own = np.empty_like(total)
            own[place] = total
            made.append(planes(own))
    return _table([(*made, None, None, None)], COUNTED, COUNTED_KINDS)


class Model:
    """Counts' sums and the mixture's weights (bucket of context, (bigram, word, uniform))."""

    def __init__(self, tokens: int, types: int, weights: np.ndarray) -> None:
        self.tokens, self.types, self.weights = tokens, types, weights

    @staticmethod
    def bucket(context: np.ndarray) -> np.ndarray:
        """0 for a context never seen, then one bucket for each power of two."""
        return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS_OF_CONTEXT - 1)

    def probability(self, bigram: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[self.bucket(context)]
        p = w[:, 1] * word / max(1, self.tokens) + w[:, 2] / (self.types + 1)
        return p + w[:, 0] * bigram / np.maximum(context, 1)


def counted(docs: DataFrame, fold: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Coded chunks with the totals of their words and bigrams. ``fold``: 0 for texts to score only, 9 for those held
    out of the estimates while weights are learned, else any other."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), fold.cast("int").alias("fold"))
    chunks = stash(rows.mapInArrow(_code, CHUNKS), "lm-chunks")
    volume = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    bits = max(4, (-(-volume // RANGE_BYTES) - 1).bit_length())
    first = min(bits, FAN_BITS)
    written = [chunks]
    sent = chunks.mapInArrow(_send(first), SENT)
    answers = _answers(sent, first, bits, max(1, volume // CHUNK_BYTES >> FAN_BITS), written)
    out = stash(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_gather, COUNTED), "lm-counted")
    unstash(*written)
    return out


def _events(tokens: int, types: int):
    """Counts of held-out events by bucket of context and by steps of the two estimates above the uniform one."""

    def steps(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.rint(np.log2(p * (types + 1)) * STEPS_PER_OCTAVE), -9999).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Coded(row)
                at = np.flatnonzero(chunk.fold == 9)
                if not len(at):
                    continue
                words, bigrams = (numbers(row[f"{n}_train"], np.int64) - numbers(row[f"{n}_nine"], np.int64) for n in ("word", "pair"))
                _, pair = chunk.pairs(len(words))
                context, word, bigram = words[chunk.context[at]], words[chunk.word[at]], bigrams[pair[at]]
                three = np.stack((Model.bucket(context), steps(bigram / np.maximum(context, 1)), steps(word / max(1, tokens))), axis=1)
                distinct, n = np.unique(three, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(distinct[:, k].astype(np.int32)) for k in range(3)), pa.array(n)], names=["bucket", "bigram", "word", "n"])

    return run


def learn(counted: DataFrame, rounds: int = 50) -> Model:
    """The mixture's weights by expectation-maximisation over all held-out counts."""
    sums = counted.agg(F.sum("tokens"), F.sum("types"), F.sum("nine_tokens")).first()
    tokens, types, nine = (int(v or 0) for v in sums)
    weights = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS_OF_CONTEXT, 1))
    weights[0] = (0.0, 0.8, 0.2)
    # at most BUCKETS_OF_CONTEXT buckets times the steps of two logarithms: bounded whatever the input
    events = counted.where("chunk is not null").mapInArrow(_events(tokens - nine, types), "bucket int, bigram int, word int, n bigint")
    rows = np.array(events.groupBy("bucket", "bigram", "word").agg(F.sum("n")).orderBy("bucket", "bigram", "word").collect(), dtype=np.int64).reshape(-1, 4)
    for b in np.unique(rows[:, 0]).tolist():
        own = rows[rows[:, 0] == b]
        value = np.stack([*(np.where(own[:, k] > -9999, np.exp2(own[:, k] / STEPS_PER_OCTAVE), 0.0) for k in (1, 2)), np.ones(len(own))], axis=1)
        w = weights[b]
        for _ in range(rounds):
            part = value * w
            w = (part / part.sum(axis=1, keepdims=True) * own[:, 3:]).sum(axis=0) + np.array([0.0 if b == 0 else 0.5, 0.5, 0.5])
            w /= w.sum()
        weights[b] = w
    if not tokens:
        weights[:] = (0.0, 0.0, 1.0)
    return Model(tokens, types, weights)


SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(counted: DataFrame, model: Model, key: T.DataType = T.LongType()) -> DataFrame:
    """For each text: its key (of the type ``key``), tokens, known tokens, training tokens, the unigram baseline and the model's log10 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Coded(row)
                words, bigrams = numbers(row["word_train"], np.int64), numbers(row["pair_train"], np.int64)
                _, pair = chunk.pairs(len(words))
                word = words[chunk.word]
                own = np.log10(model.probability(bigrams[pair], words[chunk.context], word))
                base = np.log10((words + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[chunk.word]
                cut = np.cumsum(chunk.sizes) - chunk.sizes
                with pa.ipc.open_stream(chunk.keys) as keys:
                    own_keys = keys.read_next_batch().column(0)
                columns = [
                    own_keys, pa.array(chunk.sizes), pa.array(np.add.reduceat((word > 0).astype(np.int64), cut)),
                    pa.array(np.full(len(cut), model.tokens)), pa.array(np.add.reduceat(base, cut)), pa.array(np.add.reduceat(own, cut)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("key", key), *T.StructType.fromDDL(SCORES).fields])
    return counted.where("chunk is not null").mapInArrow(run, schema)
