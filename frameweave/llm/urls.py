"""URL filters: gradient-boosted trees over lexical features, beside host and path rules.

Features of a URL: lengths of URL, host, path and query; depth of the path; labels and hyphens of the host; shares of
digits and of letters; entropy of the host's and the URL's characters; counts of parameters; whether it has a fragment;
and suffix statistics: how often URLs with the same host suffix (one and two labels), first path segment or file
extension were blocked among the labelled ones, smoothed.

Trees are grown on histograms of at most 32 bins by the gain of the logistic loss. Training takes a bounded sample of
labelled URLs.

Edge cases: a null URL, or one without ``://``, has an empty host and path and is judged by the trees like any other;
without labels of both classes every URL gets the verdict of the one there is, or ``allow``; equal URLs get equal
verdicts. Rows are kept one to one and other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import scored_by, small_batches
from ._labels import smallest_hashes

#: Bound of the sample that trees are grown on: URLs, and bytes of one.
MOST_LABELLED, MOST_URL_BYTES = 20_000, 1 << 12
BINS, TREES, DEPTH, RATE, RIDGE = 32, 40, 3, 0.2, 1.0

Rule = tuple[str, str, str]  # verdict, host, path


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _parts(urls: pa.Array) -> dict[str, pa.Array]:
    """Host (lower-cased), path and query of each URL; empty without ``://``."""
    found = pc.extract_regex(urls, r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?")
    parts = {k: pc.fill_null(pc.struct_field(found, [k]), "") for k in ("host", "path", "query")}
    parts["host"] = pc.utf8_lower(parts["host"])
    return parts


def _keys(parts: dict[str, pa.Array]) -> list[pa.Array]:
    """What the suffix statistics go by: last label, last two labels, first path segment, file extension, first label."""

    def part(of: pa.Array, pattern: str, kind: str) -> pa.Array:
        found = pc.fill_null(pc.struct_field(pc.extract_regex(of, pattern), ["k"]), "")
        return pc.binary_join_element_wise(kind, found, "")

    host, path = parts["host"], parts["path"]
    return [
        part(host, r"(?s)(?P<k>[^.]*)$", "1 "), part(host, r"(?s)(?P<k>[^.]*\.?[^.]*)$", "2 "), part(path, r"(?s)^/(?P<k>[^/]*)", "s "),
        part(path, r"(?s)\.(?P<k>[^./]*)$", "e "), part(host, r"(?s)^(?P<k>[^.]*?)[0-9]*(?:\.|$)", "p "),
    ]


def _entropy(texts: pa.Array) -> np.ndarray:
    """Bits of the distribution of bytes in each text."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(size)), size)
    codes = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    pair, n = np.unique(of * 256 + codes, return_counts=True)
    share = n / size[pair >> 8]
    return -np.bincount(pair >> 8, share * np.log2(share), minlength=len(size))


def features(urls: pa.Array, suffixes: dict[str, float], prior: float) -> np.ndarray:
    """A row of numbers for each URL."""
    parts = _parts(urls)
    host, path, query = parts["host"], parts["path"], parts["query"]
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    length = lambda a: number(pc.utf8_length(a))
    times = lambda a, s: number(pc.count_substring(a, s))
    n = np.maximum(1, length(urls))
    known, values = pa.array(list(suffixes), type=pa.string()), np.array([*suffixes.values(), prior])
    rates = [values[np.where(found < 0, len(known), found)] for k in _keys(parts) for found in [pc.fill_null(pc.index_in(k, known), -1).to_numpy(zero_copy_only=False)]]
    columns = [
        length(urls), length(host), length(path), length(query), times(path, "/"), times(host, "."), times(host, "-"),
        number(pc.count_substring_regex(urls, r"\d")) / n, number(pc.count_substring_regex(urls, r"\pL")) / n, number(pc.count_substring_regex(host, r"\d")),
        _entropy(host), _entropy(urls), times(query, "=") + times(query, "&"), number(pc.match_substring(urls, "#")), number(pc.starts_with(urls, "https")),
        *rates,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Boosted trees: flat arrays of (feature, threshold) by node of a full tree, and values by leaf."""

    base: float = -30.0
    suffixes: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def blocked(self, urls: list[str] | pa.Array) -> np.ndarray:
        """Probability that each URL is one to block."""
        if not len(urls):
            return np.zeros(0)
        x = features(pa.array(urls, type=pa.string()), self.suffixes, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def train(sample: list[tuple[str, int]]) -> Trees:
    """Trees from (url, 1 to block or 0) pairs."""
    y = np.array([float(b) for _, b in sample])
    if not len(y) or y.min() == y.max():
        return Trees(base=30.0 if len(y) and y[0] == 1 else -30.0)
    prior = float(y.mean())
    urls = pa.array([u for u, _ in sample], type=pa.string())
    seen, bad = Counter(), Counter()
    for keys in _keys(_parts(urls)):
        for k, b in zip(keys.to_pylist(), y.tolist(), strict=True):
            seen[k] += 1
            bad[k] += b
    suffixes = {k: (bad[k] + 5 * prior) / (n + 5) for k, n in seen.items() if n >= 5}
    x = features(urls, suffixes, prior)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    out = Trees(math.log(prior / (1 - prior)), suffixes, prior)
    margin = np.full(len(y), out.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        inner = 2**DEPTH - 1
        feature, threshold, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(inner):
            members = np.flatnonzero(at == node)
            best = 1e-6
            for j, e in enumerate(edges):
                if not len(members) or not len(e):
                    continue
                gs = np.cumsum(np.bincount(binned[members, j], g[members], len(e) + 1))
                hs = np.cumsum(np.bincount(binned[members, j], h[members], len(e) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE) - gs[-1] ** 2 / (hs[-1] + RIDGE)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], threshold[node] = float(gain[k]), j, e[k]
            at[members] = 2 * node + 1 + (x[members, feature[node]] > threshold[node])
        for k in range(inner + 1):
            members = at == inner + k
            leaf[k] = -RATE * g[members].sum() / (h[members].sum() + RIDGE)
        out.nodes.append((feature, threshold, leaf))
        margin += leaf[at - inner]
    return out


def fit(labelled: DataFrame, most: int = MOST_LABELLED, most_bytes: int = MOST_URL_BYTES) -> Trees:
    """Trees from a table (url, block): at most ``most`` URLs of ``most_bytes`` at most, those with the smallest hashes."""
    usable = labelled.where(F.col("block").isNotNull() & (F.octet_length("url") <= most_bytes))
    n = usable.agg(F.approx_count_distinct("url")).first()[0]
    hashed = F.xxhash64("url")
    known = smallest_hashes(usable, hashed, n, most).groupBy("url").agg(F.max("block").alias("block"))
    rows = known.orderBy(hashed, "url").limit(most).collect()
    return train([(r["url"], int(r["block"])) for r in rows])


def judge(df: DataFrame, trees: Trees, url: str = "url", into: str = "blocked") -> DataFrame:
    """``df`` with the column ``into``: the probability that the URL is one to block."""
    small_batches(df.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(trees.blocked(pc.fill_null(column, "")), type=pa.float64())

    return scored_by(df, run, url, into)
