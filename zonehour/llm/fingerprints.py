"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, the phrases' names into longer phrases, and so on. Where a
phrase ends is decided by deterministic coin tossing, that is by the few symbols around, so equal
substrings get the same phrases but for a few at their ends, wherever they stand:

1. a run of equal symbols becomes one symbol;
2. each symbol is replaced by twice the lowest bit position in which it differs from the one before, plus
   that bit; neighbours stay different. Three rounds leave labels under 8;
3. a phrase starts at each local maximum of the labels, so a phrase has 2 to about 15 symbols;
4. a phrase's name is a hash of its symbols in order.

The fingerprint keeps the least names of each level, where a phrase that comes again counts again. The
share J of equal names among the least names of both texts estimates how alike their phrases are, and
2J / (1 + J) which part of their phrases the texts share.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import arrow_map, arrow_schema, keyed_text, slices

#: Names kept of the phrases of each level (of about 3, 10, and 30 characters).
LEAST = (16, 32, 96)
#: Phrases that both texts must have at a level for it to be compared; the first level serves for all others.
ENOUGH = 12
#: Rounds of coin tossing: 64-bit symbols to labels under 128, 14, and 8.
ROUNDS = 3
#: Code points that are parsed together, so that arrays stay in the processor's cache.
TOGETHER = 200_000

RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
          " near_edited double, near_next double")

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def starts_of(text: np.ndarray) -> np.ndarray:
    """True where a symbol's text differs from the one before."""
    out = np.empty(len(text), bool)
    out[:1] = True
    np.not_equal(text[1:], text[:-1], out=out[1:])
    return out


def tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of one round; a text's first symbol is taken to differ in bit 0."""
    differs = np.empty_like(x)
    np.bitwise_xor(x[1:], x[:-1], out=differs[1:])
    differs[first] = 1
    low = differs & (~differs + x.dtype.type(1))
    place = np.bitwise_count(low - x.dtype.type(1))
    return (place << np.uint8(1)) | ((x & low) != 0)


def parsed(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, texts) of the phrases of one level; ``text`` numbers the texts, in ascending order."""
    if not len(symbols):
        return symbols.astype(np.uint64), text
    first = starts_of(text)
    head = first.copy()
    head[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(head)
    if len(at) < len(symbols):
        length = np.diff(at, append=len(symbols))
        symbols, text, first = symbols[at], text[at], first[at]
        runs = length > 1
        symbols = symbols.astype(np.uint64)
        symbols[runs] = mixed(symbols[runs] * ODD + length[runs].astype(np.uint64))
    labels = symbols
    for _ in range(ROUNDS):
        labels = tossed(labels, first)
    cut = first.copy()
    cut[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    # A text's last symbol never starts a phrase: its right side isn't known.
    ends = np.empty(len(first), bool)
    ends[-1:] = True
    ends[:-1] = first[1:]
    cut &= first | ~ends
    at = np.flatnonzero(cut)
    offset = np.arange(len(symbols)) - np.repeat(at, np.diff(at, append=len(symbols)))
    terms = mixed((symbols.astype(np.uint64) + np.uint64(1)) * ODD) * (2 * offset.astype(np.uint64) + np.uint64(3))
    return mixed(np.add.reduceat(terms, at)), text[at]


def fingerprints(texts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For each text (code points) the least 32-bit names of its phrases, ascending, by level."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    symbols = np.concatenate(texts) if texts else np.empty(0, np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    for keep in LEAST:
        symbols, text = parsed(symbols, text)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        names = (symbols >> np.uint64(32)).astype(np.uint32)
        for i, levels in enumerate(out):
            own = names[ends[i]:ends[i + 1]]
            levels.append(least_names(own, keep))
    return out


def least_names(names: np.ndarray, keep: int) -> np.ndarray:
    """The least ``keep`` names, ascending; the second, third, ... place of a name get names of their own."""
    found, counts = np.unique(names, return_counts=True)
    if len(found) < len(names):
        turn = np.arange(len(names)) - np.repeat(np.cumsum(counts) - counts, counts)
        each = np.repeat(found, counts).astype(np.uint64)
        again = turn > 0
        each[again] = mixed((each[again] << np.uint64(32) | turn[again].astype(np.uint64)) * ODD) >> np.uint64(32)
        found = np.unique(each.astype(np.uint32))
    return found[:keep]


def written(levels: list[np.ndarray]) -> str:
    """The fingerprint as text: each level's names as eight hexadecimal digits, levels parted by dots."""
    return ".".join(names.astype(">u4").tobytes().hex() for names in levels)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """0 to 1: the estimated part of the phrases that both share, on the highest level with ENOUGH in both.

    Two texts without phrases are alike.
    """
    for level in reversed(range(len(LEAST))):
        x, y = a[level], b[level]
        if level and min(len(x), len(y)) < ENOUGH:
            continue
        if not len(x) or not len(y):
            return float(len(x) == len(y))
        least = np.union1d(x, y)[:LEAST[level]]
        shared = np.count_nonzero(np.isin(least, x) & np.isin(least, y))
        return 2.0 * shared / (len(least) + shared)
    raise AssertionError


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text; no shuffle. NULL and empty texts have an empty fingerprint."""
    schema = arrow_schema("doc_id bigint, fingerprint string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 * TOGETHER):
                found = fingerprints([code_points(t or "") for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(written, found), pa.string())],
                                                 schema=schema)

    return arrow_map(keyed_text(docs), work, "doc_id bigint, fingerprint string")


def ranges(docs: DataFrame, pieces: int) -> list[int]:
    """Ascending doc_ids that cut the rows into about equal ranges; at most ``pieces`` - 1 numbers."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 10 * pieces)).first()[0]
    return sorted(set(cuts or []))


def with_next(docs: DataFrame) -> DataFrame:
    """The texts dealt by ranges of doc_id, sorted in each, each range followed by the next one's first row.

    Columns: doc_id, text, ``_range`` and ``_extra`` (true for the row that only lends its text). NULL doc_ids
    come last; rows with equal doc_ids go by their text's hash. After the last row comes the first.
    """
    pieces = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed_text(docs).withColumn("_tie", F.xxhash64("text"))
    cuts = ranges(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), pieces)
    number = range_number(cuts)
    placed = rows.withColumn("_range", number(F.coalesce("doc_id", F.lit((1 << 63) - 1))))
    heads = placed.groupBy("_range").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("void"), "doc_id", "_tie")).alias("head")).orderBy("_range").collect()
    if not heads:
        return placed.withColumn("_extra", F.lit(False))
    # One row a range: the range before it gets a copy of its first row.
    lent = docs.sparkSession.createDataFrame(
        [(heads[i - 1]["_range"], h["head"]["doc_id"], h["head"]["_tie"]) for i, h in enumerate(heads)],
        "_for int, _id bigint, _hash bigint")
    extra = rows.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_hash")))
    both = placed.withColumn("_extra", F.lit(False)).unionByName(
        extra.withColumn("_range", F.col("_for")).withColumn("_extra", F.lit(True)).select(*placed.columns, "_extra"))
    return both.repartition("_range").sortWithinPartitions(
        "_range", "_extra", F.col("doc_id").asc_nulls_last(), "_tie")


def range_number(cuts: list[int]):
    """A function of a column: how many of ``cuts`` are at most its value."""
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf(IntegerType())
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    return number


def edited_digests(docs: DataFrame) -> DataFrame:
    """RESULT's columns of every row: the text's fingerprint and that of its edited text, and their likeness.

    The edited text has its last quarter (whole code points, rounded down) replaced by as much of the start
    of the next document. NULL texts are empty; a single row's next document is itself; equal texts
    have equal fingerprints. Texts are shuffled once, by ranges of doc_id; the driver gets the ranges' bounds
    and first ids, as many as there are shuffle partitions. Rows with one doc_id lie in one range.
    """
    schema = arrow_schema(RESULT)

    def finish(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Results of all rows but the last, which is the next document of the one before."""
        points = [code_points(t) for _, t in rows]
        edited = []
        for own, following in zip(points, points[1:]):
            quarter = len(own) // 4
            edited.append(np.concatenate([own[:len(own) - quarter], following[:quarter]]))
        found = fingerprints(points + edited)
        n = len(edited)
        own, changed = found[:n + 1], found[n + 1:]
        return pa.RecordBatch.from_pydict({
            "doc_id": [d for d, _ in rows[:n]], "n_chars": [len(p) for p in points[:n]],
            "edited_sha256": [hashlib.sha256(e.tobytes().decode("utf-32-le").encode()).hexdigest() for e in edited],
            "fingerprint": [written(f) for f in own[:n]], "edited_fingerprint": [written(f) for f in changed],
            "near_edited": [likeness(a, b) for a, b in zip(own, changed)],
            "near_next": [likeness(a, b) for a, b in zip(own, own[1:])]}, schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str]] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text, extra in zip(*(part[c].to_pylist() for c in ("doc_id", "text", "_extra"))):
                    text = text or ""
                    rows.append((doc_id, text))
                    size += len(text)
                    if extra or size > TOGETHER:
                        if len(rows) > 1:
                            yield finish(rows)
                        rows, size = ([], 0) if extra else (rows[-1:], len(text))

    return arrow_map(with_next(docs).select("doc_id", "text", "_extra"), work, RESULT)
