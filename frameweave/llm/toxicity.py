"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text and normalised by length.

Folding decomposes compatibility forms, drops accents and characters that have no width, lower-cases, maps homoglyphs
(Cyrillic, Greek, full-width) and digit substitutions to one letter each (l, i and 1 are one) and everything that is no
letter to a space. A lexicon entry is the start of a word, or a whole word if it ends in a space. Its weight is the log ratio of its rates among the words of toxic and clean texts.
An exception phrase takes away the hits that lie inside it; exceptions are given, or learned: an entry's word with the one
before or after it, where that pair occurs in several clean texts and, for its frequency, hardly in toxic ones. The weights of a text's hits are summed and divided by
its words; a logistic curve over that density makes the score, so that a chance hit in a long text weighs little.

``learn`` chooses entries from labelled texts: words and word starts that occur far more often in toxic texts, taken
greedily as long as each explains toxic texts that those before it don't; then those that are many times as frequent,
whatever stands beside them. Near copies count once.

Edge cases: null and empty texts have no hits and get the score of a text without hits; very long texts are scored
whole; equal texts get equal scores; with no toxic labels the lexicon is empty and every score 0. Rows are kept one to
one and other columns pass through.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ._io import give_back, scored_by, small_batches
from ._labels import class_weights, labelled_sample

#: Bound of the sample that the lexicon is learned from: rows of either class, and bytes of a row.
PER_CLASS, MOST_BYTES = 3000, 1 << 16

# --- fixed values: look-alikes of Latin letters, and digits or signs that stand for letters ---
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i"}
DEFAULT_EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "sore loser", "idiot proof")


#: Accents and selectors that stand on any letter; the vowel signs of scripts that have such are not among them.
MARKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F))


def _bare(c: str) -> bool:
    """Whether a character only adorns, or has no width."""
    return any(a <= ord(c) <= b for a, b in MARKS) or unicodedata.category(c) == "Cf"


class _Fold(dict):
    """Translation table that works out each character once; one can become several letters, or none."""

    def __missing__(self, code: int) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not _bare(c))
        letters = (LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFC", bare).lower())
        out = self[code] = "".join(c if c.isalnum() else " " for c in (SUBSTITUTES.get(c, c) for c in letters))
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """``text`` folded, between two spaces."""
    return f" {text.translate(_FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights (``" start"`` or ``" word "``), exception phrases (folded), and the logistic curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def matcher(self):
        """A function from text to score."""
        import ahocorasick

        if not self.weights:
            return lambda text: 0.0
        trie = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            trie.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            trie.add_word(phrase, (len(phrase), self.weights.get(phrase) if phrase in self.weights else None))
        trie.make_automaton()
        a, b, c = self.curve

        def score(text: str) -> float:
            folded = fold(text)
            hits, spared = [], []
            for end, (size, weight) in trie.iter(folded):
                if weight is None:
                    spared.append((end - size + 1, end))
                else:
                    hits.append((end - size + 1, end, weight))
            total = sum(w for _, _, w in hits) if not spared else _outside(hits, spared)
            if not total:
                return 1 / (1 + math.exp(-a))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b + c * density(total, folded)))))

        return score


def _outside(hits: list[tuple[int, int, float]], spared: list[tuple[int, int]]) -> float:
    """Weight of the hits that lie inside none of the spared spans: one pass over both in the order of their starts."""
    hits.sort()
    spared.sort()
    total, k, reach = 0.0, 0, -1
    for start, end, weight in hits:
        while k < len(spared) and spared[k][0] <= start:
            reach = max(reach, spared[k][1])
            k += 1
        if reach < end:
            total += weight
    return total


def density(total: float, folded: str) -> float:
    """Logarithm of the hits' weight for every thousand words."""
    return math.log1p(1000 * total / (len(folded.split()) + 10))


def _starts(folded: str, shortest: int = 4, longest: int = 9) -> Counter[str]:
    """Occurrences of words, each between spaces, and of their starts, each after a space, n of them as 1 + log2(n)."""
    out: Counter[str] = Counter()
    for word, n in Counter(folded.split()).items():
        out[f" {word} "] += n
        for k in range(shortest, min(longest, len(word)) + 1):
            out[f" {word[:k]}"] += n
    return Counter({s: 1 + math.log2(n) for s, n in out.items()})


def _unlike(texts: list[str], hashes: int = 8) -> list[str]:
    """Texts without those that share half their min-hashed words with one before: copies are no evidence of their own."""
    seen: list[dict[int, int]] = [{} for _ in range(hashes)]
    kept = []
    for t in texts:
        words = [w.encode() for w in set(t.split())]
        if not words:
            continue
        marks = [min(zlib.crc32(w, 7919 * k) for w in words) for k in range(hashes)]
        before = Counter(seen[k][m] for k, m in enumerate(marks) if m in seen[k])
        if max(before.values(), default=0) * 2 >= hashes:
            continue
        for k, m in enumerate(marks):
            seen[k].setdefault(m, len(kept))
        kept.append(t)
    return kept


def _frequent(texts: list[str], least: int, shortest: int = 4, longest: int = 9) -> set[str]:
    """Words and starts of words, as ``_starts`` has them, whose words together are in at least ``least`` texts: all that single
    texts could confirm. One first letter at a time, so that the starts of all words are never held at once."""
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update(set(t.split()))
    by_letter: defaultdict[str, list[str]] = defaultdict(list)
    for w in seen:
        by_letter[w[0]].append(w)
    out = {f" {w} " for w, n in seen.items() if n >= least}
    for own in by_letter.values():
        bound: Counter[str] = Counter()
        for w in own:
            for k in range(shortest, min(longest, len(w)) + 1):
                bound[w[:k]] += seen[w]
        out |= {f" {s}" for s, n in bound.items() if n >= least}
    return out


def _exceptions(weights: dict[str, float], toxic: list[str], clean: list[str], least_ratio: float, least_texts: int) -> set[str]:
    """Pairs of words of which one is an entry's, that at least ``least_texts`` clean texts have and that toxic texts have
    ``exp(least_ratio)`` times less often, for the number of texts of either kind."""
    starts = tuple(w for w in weights if not w.endswith(" "))
    seen: list[Counter[str]] = [Counter(), Counter()]
    for part, counts in zip((toxic, clean), seen, strict=True):
        for t in part:
            words = t.split()
            hot = [f" {w} " in weights or f" {w}".startswith(starts) for w in words]
            counts.update({f" {a} {b} " for a, b, x, y in zip(words, words[1:], hot, hot[1:], strict=False) if x or y})
    rate = lambda n, part: math.log((n + 0.5) / (len(part) + 1))
    return {p for p, n in seen[1].items() if n >= least_texts and rate(n, clean) - rate(seen[0][p], toxic) >= least_ratio}


def learn(sample: list[tuple[str, int]], totals: dict[int, int], exceptions: tuple[str, ...] = DEFAULT_EXCEPTIONS, least_ratio: float = 2.5, least_new: int = 6) -> Lexicon:
    """A lexicon from (text, toxic) pairs. ``least_ratio``: of an entry's weight, and of an exception's; ``least_new``: texts
    that an entry must add, and clean ones that a learned exception must stand in."""
    spared = tuple(fold(e) for e in exceptions)
    toxic = _unlike([fold(t) for t, y in sample if y == 1])
    clean = _unlike([fold(t) for t, y in sample if y == 0])
    if not toxic or not clean:
        return Lexicon({}, spared, (0.0, 0.0, 0.0))
    common = _frequent(toxic, least_new)
    words = [sum(len(t.split()) for t in part) + 1 for part in (toxic, clean)]
    times: list[Counter[str]] = [Counter(), Counter()]
    texts_of: defaultdict[str, set[int]] = defaultdict(set)
    for part, counts in zip((toxic, clean), times, strict=True):
        for i, t in enumerate(part):
            for s, n in _starts(t).items():
                if s in common:
                    counts[s] += n
                    if part is toxic:
                        texts_of[s].add(i)
    common = {s for s in common if len(texts_of[s]) >= least_new}
    ratio = {s: math.log((times[0][s] + 0.5) / words[0]) - math.log((times[1][s] + 0.5) / words[1]) for s in common}
    texts_of = {s: texts_of[s] for s, r in ratio.items() if r >= least_ratio}
    strong = {s: len(texts_of[s]) for s in texts_of if ratio[s] >= 2 * least_ratio and len(texts_of[s]) >= max(2 * least_new, 0.02 * len(toxic))}
    weights: dict[str, float] = {}
    covered: set[int] = set()
    while texts_of:
        best = max(texts_of, key=lambda s: (len(texts_of[s] - covered), ratio[s], -len(s), s))
        new = texts_of.pop(best) - covered
        if len(new) < least_new:
            break
        weights[best] = ratio[best]
        covered |= new
    for s in sorted(strong, key=lambda s: (-strong[s], len(s), s)):  # evidence beside that of others; the shortest start that has it
        if not any(s.startswith(k) for k in weights):
            weights[s] = ratio[s]
    weights = {s: w for s, w in weights.items() if not any(s != k and s.startswith(k) for k in weights)}
    if weights:
        spared = (*spared, *sorted(_exceptions(weights, toxic, clean, least_ratio, least_new) - set(spared) - set(weights)))
    probe = Lexicon(weights, spared, (0.0, 0.0, 1.0)).matcher()
    xs, ys, ws = [], [], []
    share = class_weights([y for _, y in sample], totals)
    for text, y in sample:
        raw = probe(text)
        x = math.log(raw / (1 - raw)) if 0.5 < raw < 1 else 0.0
        xs.append((1.0, float(x > 0), x))
        ys.append(y)
        ws.append(share[y])
    del toxic, clean, texts_of
    return Lexicon(weights, spared, tuple(_logistic(np.array(xs), np.array(ys, dtype=float), np.array(ws)).tolist()))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Lexicon:
    """A lexicon from the labels that ``train`` admits."""
    try:
        return learn(*labelled_sample(docs, labels, "toxic", train, per_class, most_bytes))
    finally:
        give_back()


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the column ``into``, from 0 to 1, higher where toxic is likelier. Only the text goes to Python."""
    small_batches(df.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = lexicon.matcher()
        for column in columns:
            yield pa.array([of(t.as_py() or "") for t in column], type=pa.float64())
        give_back()

    return scored_by(df, run, text, into)
