"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters see eight bytes and move by four. A document is covered by
overlapping chunks. In each chunk every filter keeps its largest response, rectified. Over the chunks of the
document the maximum, the mean and the minimum of those are taken and combined by a small hidden layer into one
probability.

Edge cases: a null or empty text is a chunk of zero bytes; long texts are scored whole, however many chunks they
have; equal texts get equal scores whatever batch they come in; without labels of both classes every score is the
share of the one there is, or one half. Rows are kept one to one and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ._io import give_back, scored_by, small_batches, text_bytes
from ._labels import class_weights, labelled_sample

#: Bound of the sample that the network is trained on: rows of either class, and bytes of a row.
PER_CLASS, MOST_BYTES = 1500, 1 << 17
CHUNK, OVERLAP, WIDTH, STRIDE = 512, 64, 8, 4
STEP = CHUNK - OVERLAP
FILTERS, DIMS, HIDDEN = 24, 6, 16
#: Chunks that go through the filters at once; some 30 KB each.
BLOCK_CHUNKS = 1024


@dataclass
class Network:
    """Weights: byte vectors, filters with offsets, hidden layer, output. ``constant``: the score without training."""

    p: dict[str, np.ndarray] | None
    constant: float = 0.5

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text, in blocks of chunks: what a long text needs at once doesn't grow with it."""
        if self.p is None:
            return np.full(len(texts), self.constant)
        n = len(texts)
        high, total, low = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS)), np.full((n, FILTERS), np.inf, np.float32)
        chunks = np.zeros(n, dtype=np.int64)
        for of, runs in _blocks(texts):
            top, counts = self._responses(runs)
            cut = np.cumsum(counts) - counts
            np.maximum.at(high, of, np.maximum.reduceat(top, cut))
            np.add.at(total, of, np.add.reduceat(top, cut, dtype=np.float64))
            np.minimum.at(low, of, np.minimum.reduceat(top, cut))
            np.add.at(chunks, of, counts)
        pooled = np.concatenate((high, total / np.maximum(chunks, 1)[:, None], low), axis=1)
        return _head(self.p, pooled.astype(np.float32))[0]

    def _responses(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk of padded runs, and the number of chunks of each."""
        p = self.p
        sizes = np.array([len(r) for r in runs], dtype=np.int64)
        data = np.frombuffer(b"".join(runs) + b"\0" * WIDTH, dtype=np.uint8)
        vectors = p["bytes"][data].ravel()
        half = STRIDE * DIMS
        even = vectors[: (len(data) - WIDTH) * DIMS].reshape(-1, WIDTH * DIMS) @ p["filters"]
        odd = vectors[half : half + (len(data) - WIDTH) * DIMS].reshape(-1, WIDTH * DIMS) @ p["filters"]
        starts = np.cumsum(sizes) - sizes
        chunks = -(-(sizes - OVERLAP) // STEP)
        of = np.repeat(np.arange(len(runs)), chunks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        first = np.minimum(nth * STEP, sizes[of] - CHUNK) // WIDTH  # the last chunk ends with the run
        first += starts[of] // WIDTH
        n = CHUNK // WIDTH
        top = np.maximum(_ranges(even, first, first + n), _ranges(odd, first, first + n - 1))
        return np.maximum(top + p["offsets"], 0), chunks


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of whole chunks, of ``BLOCK_CHUNKS`` in all at most, and the number of each one's text. A text's runs overlap as
    its chunks do, so that all runs together have just the text's chunks."""
    of, runs, held = [], [], 0
    for i, t in enumerate(texts):
        size = max(CHUNK, -(-len(t) // WIDTH) * WIDTH)
        left, at = -(-(size - OVERLAP) // STEP), 0
        while left:
            some = min(left, BLOCK_CHUNKS - held)
            end = size if some == left else at + (some - 1) * STEP + CHUNK
            begin = min(at, end - CHUNK)  # the last chunk ends with the text, if that means that it begins earlier
            of.append(i)
            runs.append(t[begin:end].ljust(end - begin, b"\0"))
            left, at, held = left - some, at + some * STEP, held + some
            if held == BLOCK_CHUNKS:
                yield np.array(of), runs
                of, runs, held = [], [], 0
    if runs:
        yield np.array(of), runs


def _ranges(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest of each column over the rows of each range."""
    x = np.concatenate((x, x[-1:]))
    return np.maximum.reduceat(x, np.stack((start, end), axis=1).ravel())[::2]


def _head(p: dict[str, np.ndarray], pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = (pooled - p["shift"]) * p["stretch"]
    hidden = np.maximum(z @ p["hidden"] + p["hidden_offsets"], 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ p["out"] + p["out_offset"], -30, 30))).astype(np.float64), hidden, z


def _windows(text: bytes) -> np.ndarray:
    """Byte windows (chunks, windows, WIDTH) of all chunks."""
    b = np.frombuffer(text.ljust(max(CHUNK, -(-len(text) // WIDTH) * WIDTH), b"\0"), dtype=np.uint8)
    n = -(-(len(b) - OVERLAP) // STEP)
    starts = np.minimum(np.arange(n) * STEP, len(b) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(b, WIDTH)[starts[:, None] + np.arange(0, CHUNK - WIDTH + 1, STRIDE)]


def train(sample: list[tuple[bytes, int]], totals: dict[int, int], passes: int = 6, rate: float = 4e-3, seed: int = 5) -> Network:
    """A network from (text, label) pairs; ``totals`` gives the classes their true shares."""
    ys = [y for _, y in sample]
    if not sample or len(set(ys)) < 2:
        return Network(None, float(ys[0]) if sample else 0.5)
    rng = np.random.default_rng(seed)
    p = {
        "bytes": rng.normal(0, 0.5, (256, DIMS)).astype(np.float32), "filters": rng.normal(0, 0.3, (WIDTH * DIMS, FILTERS)).astype(np.float32),
        "offsets": np.zeros(FILTERS, np.float32), "hidden": rng.normal(0, 0.2, (3 * FILTERS, HIDDEN)).astype(np.float32),
        "hidden_offsets": np.zeros(HIDDEN, np.float32), "out": rng.normal(0, 0.2, HIDDEN).astype(np.float32), "out_offset": np.zeros(1, np.float32),
        "shift": np.zeros(3 * FILTERS, np.float32), "stretch": np.full(3 * FILTERS, 0.5, np.float32),
    }
    learned = [k for k in p if k not in ("shift", "stretch")]
    m, v = {k: np.zeros_like(p[k]) for k in learned}, {k: np.zeros_like(p[k]) for k in learned}
    share = class_weights(ys, totals)
    step, size = 0, 32
    steps = passes * -(-len(sample) // size)
    for turn in range(passes):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), size):
            members = order[at : at + size]
            windows = [_windows(sample[i][0]) for i in members]
            counts = np.array([len(w) for w in windows])
            w = np.concatenate(windows)
            x = p["bytes"][w].reshape(len(w), w.shape[1], WIDTH * DIMS)
            response = x @ p["filters"]
            peak = response.argmax(axis=1)
            raw = np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0] + p["offsets"]
            top = np.maximum(raw, 0)
            cut = np.cumsum(counts) - counts
            pooled = np.concatenate((np.maximum.reduceat(top, cut), np.add.reduceat(top, cut) / counts[:, None], np.minimum.reduceat(top, cut)), axis=1)
            if turn == 0 and at == 0:
                p["shift"] = pooled.mean(axis=0).astype(np.float32)
                p["stretch"] = (1 / (pooled.std(axis=0) + 0.1)).astype(np.float32)
            prob, hidden, z = _head(p, pooled)
            y = np.array([sample[i][1] for i in members])
            weight = np.array([share[int(k)] for k in y])
            g: dict[str, np.ndarray] = {}
            d = ((prob - y) * weight / len(y)).astype(np.float32)
            g["out"], g["out_offset"] = hidden.T @ d, d.sum(keepdims=True)
            dh = np.outer(d, p["out"]) * (hidden > 0)
            g["hidden"], g["hidden_offsets"] = z.T @ dh, dh.sum(axis=0)
            dpool = (dh @ p["hidden"].T) * p["stretch"]
            of = np.repeat(np.arange(len(counts)), counts)
            f = FILTERS
            largest, smallest = pooled[:, :f], pooled[:, 2 * f :]
            dtop = dpool[of, f : 2 * f] / counts[of, None]
            dtop = dtop + dpool[of, :f] * (top == largest[of]) + dpool[of, 2 * f :] * (top == smallest[of])
            dtop = dtop * (raw > 0)
            g["offsets"] = dtop.sum(axis=0)
            seen = np.take_along_axis(x[:, :, :, None], peak[:, None, None, :], axis=1)[:, 0]  # (chunks, WIDTH * DIMS, FILTERS)
            g["filters"] = np.einsum("cif,cf->if", seen, dtop)
            at_peak = np.take_along_axis(w[:, :, :, None], peak[:, None, None, :], axis=1)[:, 0]  # (chunks, WIDTH, FILTERS)
            back = dtop[:, None, None, :] * p["filters"].reshape(WIDTH, DIMS, f)[None]
            g["bytes"] = np.zeros_like(p["bytes"])
            np.add.at(g["bytes"], at_peak.transpose(0, 1, 2).ravel(), back.transpose(0, 1, 3, 2).reshape(-1, DIMS))
            step += 1
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k in learned:
                grad = g[k] + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(p)


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Network:
    """A network from the labels that ``train_rows`` admits."""
    sample, totals = labelled_sample(docs, labels, "quality", train_rows, per_class, most_bytes)
    try:
        return train([(t.encode(), y) for t, y in sample], totals)
    finally:
        give_back()


def score(df: DataFrame, network: Network, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the column ``into``, from 0 to 1, higher where the text is likelier good. Only the text goes to Python."""
    small_batches(df.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(_steady(network, text_bytes(column)), type=pa.float64())
        give_back()

    return scored_by(df, run, text, into)


def _steady(network: Network, texts: list[bytes]) -> np.ndarray:
    """Scores rounded, since sums of single precision depend on a matrix's shape in their last places."""
    return np.round(network.scores(texts), 4)
