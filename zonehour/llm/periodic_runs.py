"""Periodic runs of words, found by internal pattern matching.

The words of many texts are numbered, one text after another, each text with numbers of its own and a
separator that occurs once. Prefix doubling sorts the suffixes that share at least two words with
another one; at each step the suffixes that agree in 2, 4, 8, ... words are one range of the suffix
array. A wavelet tree over the array answers range-successor queries: the next (or last) position after
(before) p among the suffixes of a range.

A run of period q and length >= 4q (6 for q = 1) contains a block of b words at a multiple of b, b being
the power of two with q <= b < 2q (2 for q = 1), that has room for a copy of itself q words later or
earlier. That copy is the block's nearest occurrence in the neighbouring window of b positions, since
nearer ones would give a smaller period; such occurrences form a progression whose step is the period.
So one successor and one predecessor query per block give every candidate; each is then extended word
by word as far as the period holds.
"""

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import keyed_text, text_rows

#: Fixed values of the definition: a run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_POWER = 6, 4
#: Bytes of text whose words are sorted together; a longer text is sorted alone.
SLICE_BYTES = 4 << 20


class RangeSuccessor:
    """Wavelet tree (as a matrix of bit counts) over a permutation; queries come as arrays."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in reversed(range(max(1, (len(values) - 1).bit_length()))):
            high = (values >> bit & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(high, out=ones[1:])
            self.levels.append((bit, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[~high], values[high]])

    def below(self, lo, hi, value) -> np.ndarray:
        """How many entries at places lo to hi - 1 are smaller than ``value``."""
        count = np.zeros(len(lo), np.int64)
        for bit, ones, zeros in self.levels:
            up = (value >> bit & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            count += np.where(up, (hi - hi1) - (lo - lo1), 0)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return count

    def at(self, lo, hi, k) -> np.ndarray:
        """The k-th smallest entry (from 0) at places lo to hi - 1; k must be inside."""
        value = np.zeros(len(lo), np.int64)
        for bit, ones, zeros in self.levels:
            lo1, hi1 = ones[lo], ones[hi]
            lower = (hi - hi1) - (lo - lo1)
            up = k >= lower
            k = np.where(up, k - lower, k)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
            value |= up.astype(np.int64) << bit
        return value

    def neighbours(self, lo, hi, value):
        """The next larger and next smaller entry at places lo to hi - 1 (``value`` is there); -1: none."""
        k, most = self.below(lo, hi, value), hi - lo - 1
        larger = np.where(k < most, self.at(lo, hi, np.minimum(k + 1, most)), -1)
        smaller = np.where(k > 0, self.at(lo, hi, np.maximum(k - 1, 0)), -1)
        return larger, smaller


def repeated_blocks(ids: np.ndarray, longest: int):
    """(suffix array of the repeated suffixes, [(b, positions, lo, hi), ...]).

    One entry of the list for each power of two b up to ``longest``: the multiples of b whose next b
    words occur again, with the range of the array that holds all their occurrences. ``ids`` ends in an
    id that occurs once.
    """
    n = len(ids)
    key = ids[:-1] * (int(ids.max()) + 2) + ids[1:]
    order = np.argsort(key, kind="stable")
    heads, counts = _classes(key[order])
    rank = np.full(n, n, np.int64)
    rank[order] = np.repeat(heads, counts)
    again = np.repeat(counts > 1, counts)
    place = np.cumsum(again) - again  # where a suffix stands when all that don't repeat are left out
    everyone = active = order[again]
    blocks, b = [], 2
    while len(active):
        starts = rank[active]
        heads, counts = _classes(starts)
        grid = active % b == 0
        lo = place[starts[grid]]
        blocks.append((b, active[grid], lo, lo + np.repeat(counts, counts)[grid]))
        if 2 * b > longest:
            break
        key = starts * (n + 1) + rank[active + b]
        by = np.argsort(key, kind="stable")
        active, starts = active[by], starts[by]
        new, sizes = _classes(key[by])
        rank[active] = starts + np.repeat(new, sizes) - np.repeat(heads, counts)
        active = active[np.repeat(sizes > 1, sizes)]
        b *= 2
    return everyone[np.argsort(rank[everyone], kind="stable")], blocks


def _classes(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each stretch of equal entries."""
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return heads, np.diff(np.append(heads, len(ordered)))


def candidates(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of stretches that repeat with a period; each run has one inside."""
    array, blocks = repeated_blocks(ids, longest)
    if not len(array):
        return []
    positions = np.sort(array)
    tree = RangeSuccessor(np.searchsorted(positions, array))
    found, far = [], len(ids)
    for b, at, lo, hi in blocks:
        later, earlier = tree.neighbours(lo, hi, np.searchsorted(positions, at))
        step = np.where(later >= 0, positions[later] - at, far)
        found.append(np.stack([step, at, at + step + b])[:, step <= b])
        step = np.where(earlier >= 0, at - positions[earlier], far)
        found.append(np.stack([step, at - step, at + b])[:, step <= b])
    step, start, end = np.concatenate(found, axis=1)
    by = np.lexsort((start, step))
    step, start, end = step[by], start[by], end[by]
    # Stretches of one period that share a whole period are parts of the same run.
    reach = np.maximum.accumulate(end + step * (len(ids) + 1)) - step * (len(ids) + 1) if len(step) else end
    fresh = np.ones(len(step), bool)
    fresh[1:] = (step[1:] != step[:-1]) | (start[1:] > reach[:-1] - step[1:])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(step)) - 1 if len(heads) else heads
    return list(zip(step[heads].tolist(), start[heads].tolist(), reach[tails].tolist()))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, looked at in pieces that double."""
    at, piece, most = 0, 16, min(len(a), len(b))
    while at < most:
        differs = a[at:at + piece][:most - at] != b[at:at + piece][:most - at]
        if differs.any():
            return at + int(differs.argmax())
        at, piece = at + piece, 2 * piece
    return most


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start and period.

    A run has a smallest period q, at least max(6, 4 q) words, and no neighbouring word that keeps the
    period. Lists without words have no runs. Time and memory are n log n in the number of words.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    numbers, ends = [], []
    for words in texts:
        known: dict = {}
        base = len(numbers) + len(ends)
        numbers.extend([known.setdefault(w, base + len(known)) for w in words])
        ends.append(len(numbers))
    if not numbers:
        return out
    lengths = np.diff([0, *ends])
    closing = np.array(ends) + np.arange(len(ends))
    ids = np.full(len(numbers) + len(ends), -1, np.int64)
    inside = np.ones(len(ids), bool)
    inside[closing] = False
    # Words keep the number of a place in their own text; separators have one of their own each.
    ids[inside] = numbers
    ids[closing] = len(ids) + np.arange(len(ends))
    first = closing - lengths
    for step, start, end in candidates(ids, max(2, int(lengths.max()) // 2)):
        end += _agree(ids[end - step:], ids[end:])
        start -= _agree(ids[:start][::-1], ids[step:start + step][::-1])
        if end - start >= max(LEAST_WORDS, LEAST_POWER * step):
            text = int(np.searchsorted(closing, start))
            out[text].append((start - int(first[text]), end - start, step))
    return [sorted(set(runs)) for runs in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\x20\x09-\x0D]+` in UTF-8."""
    return (text or "").encode().split()


def run_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed): every run as struct(start, length, period), and the text that is left.

    One row for each row of ``docs``; NULL and empty texts have no runs and an empty rest; a NULL doc_id
    stays NULL; repeated rows are treated alike; other columns are ignored. No shuffle; memory is bounded
    by slices of texts, or by the longest text.
    """
    def work(rows: dict) -> dict:
        words = [words_of(t) for t in rows["text"]]
        runs = find_runs(words)
        return {"doc_id": rows["doc_id"],
                "runs": [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs],
                "collapsed": [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]}

    return text_rows(keyed_text(docs), "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
                     "collapsed string", work, SLICE_BYTES)


def with_planted_run(doc_id: int | None, words: list) -> list:
    """Every tenth document, by the hash of its id, ends in a periodic part; a NULL id never does."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[:n - a]


DIGESTS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
           "runs_sha256 string, collapsed_sha256 string")


def run_digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest run, and digests of all runs and of the collapsed text.

    Texts are taken with their planted runs. The longest run is the first of the longest, then the one with
    the smaller period; without runs it is four NULLs. Odd rows are treated as in ``run_rows``.
    """
    def work(rows: dict) -> dict:
        words = [with_planted_run(d, words_of(t)) for d, t in zip(rows["doc_id"], rows["text"])]
        out: dict[str, list] = {field.split()[0]: [] for field in DIGESTS.split(", ")}
        out["doc_id"] = rows["doc_id"]
        for text, runs in zip(words, find_runs(words)):
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            out["n_runs"].append(len(runs))
            for name, value in zip(("start", "length", "period"), best):
                out[name].append(value)
            out["exponent_milli"].append(1000 * best[1] // best[2] if runs else None)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(b" ".join(collapsed(text, runs))).hexdigest())
        return out

    return text_rows(keyed_text(docs), DIGESTS, work, SLICE_BYTES)
