"""Line dedup by range-partitioned hashes; the result is a compressed keep bitmap for each document.

A row for each (document, distinct key) carries the key's 128-bit hash and its positions. Rows are dealt
by ranges of (hash, document), so one key's rows may lie in several ranges, and are sorted within them.
Each task then streams its rows once. Only the first and the last key of a range can go on in another;
what can't be decided there waits for the counts of these boundary keys, two rows a range.
"""

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from zonehour.sources.shared import save_round

from .common import arrow_map, arrow_schema, keyed_text, packed, ship, slices, text_rows

#: Fixed value: white space that is stripped from both ends of a line, as bytes.
STRIPPED = b" \t\n\x0b\x0c\r"

LINES = "h1 bigint, h2 bigint, doc_id bigint, body bigint, pos array<int>, n_lines int"
FOUND = "kind string, part int, h1 bigint, h2 bigint, n bigint, doc_id bigint, body bigint, drop array<int>, n_lines int"

#: Rows that wait in a streaming task before they are passed on.
OUT_ROWS = 20_000


def line_keys(docs: DataFrame) -> DataFrame:
    """A row for each document and distinct key: lower-cased (A to Z) lines without white space at both ends.

    Lines whose key is empty have no row.
    """
    lines = arrow_schema(LINES)
    halves = np.dtype("<i8")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, ids, bodies, places, counts = [], [], [], [], []
                for doc_id, body, text in zip(*(part[c].to_pylist() for c in ("doc_id", "body", "text"))):
                    found: dict[bytes, list[int]] = {}
                    keys = (text or "").encode().lower().split(b"\n")
                    for at, key in enumerate(keys):
                        if key := key.strip(STRIPPED):
                            found.setdefault(key, []).append(at)
                    hashes += [xxhash.xxh3_128_digest(k) for k in found]
                    places += found.values()
                    ids += [doc_id] * len(found)
                    bodies += [body] * len(found)
                    counts += [len(keys)] * len(found)
                h = np.frombuffer(b"".join(hashes), halves).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(bodies, pa.int64()),
                     pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.int32())], schema=lines)

    return arrow_map(docs, split, LINES)


class RangeStream:
    """One task's sorted rows, key by key. ``min_docs`` None: all but the first occurrence of a key go."""

    def __init__(self, part: int, min_docs: int | None):
        self.part, self.min_docs, self.out = part, min_docs, []
        self.key, self.doc, self.n, self.waiting, self.head = None, None, 0, [], True

    def _emit(self, kind: str, row: dict | None = None, drop: list | None = None, n: int | None = None) -> None:
        row = row or {}
        self.out.append({"kind": kind, "part": self.part, "h1": self.key[0], "h2": self.key[1], "n": n,
                         "doc_id": row.get("doc_id"), "body": row.get("body"), "drop": drop,
                         "n_lines": row.get("n_lines")})

    def add(self, row: dict) -> None:
        key, doc = (row["h1"], row["h2"]), (row["doc_id"], row["body"])
        if key != self.key:
            if self.key is not None:
                self.end(last=False)
            self.key, self.doc, self.n = key, None, 0
        if doc == self.doc:  # the same row again: one document
            return
        self.doc = doc
        self.n += 1
        if self.min_docs is None:
            if self.n > 1:
                self._emit("drop", row, row["pos"])
            elif self.head:
                self._emit("wait", row, row["pos"])
            elif len(row["pos"]) > 1:
                self._emit("drop", row, row["pos"][1:])
        elif self.n >= self.min_docs:
            for waiting in self.waiting:
                self._emit("drop", waiting, waiting["pos"])
            self.waiting = []
            self._emit("drop", row, row["pos"])
        else:
            self.waiting.append(row)  # fewer than min_docs

    def end(self, last: bool) -> None:
        """The key's rows in this range are over; at the range's ends it may have more elsewhere."""
        if self.head or last:
            self._emit("count", n=self.n)
            for waiting in self.waiting:
                self._emit("wait", waiting, waiting["pos"])
        self.waiting, self.head = [], False

    def take(self) -> list[dict]:
        out, self.out = self.out, []
        return out


def keep_bitmaps(docs: DataFrame, min_docs: int | None = None) -> DataFrame:
    """(doc_id, body, n_lines, n_dropped, keep) for each document that loses lines.

    ``min_docs``: keys found in so many documents lose all their lines; None: each key's first occurrence,
    by (doc_id, text hash, position), stays and all others go. ``keep`` is a zlib-compressed bitmap with a
    bit for each line, most significant first, 1 to keep. ``body`` is the text's hash: rows that agree
    in doc_id and text are one document. Documents without a row lose nothing; so do NULL and empty texts
    (one empty line) and white space. NULL doc_id is a value like others.

    A key with a third of all rows is dealt over as many ranges as its rows need, and no task holds more
    rows of a key than ``min_docs``. The found rows are written to the shared folder once.
    """
    rows = line_keys(keyed_text(docs).withColumn("body", F.xxhash64("text")))
    order = ["h1", "h2", "doc_id", "body"]
    found_schema = arrow_schema(FOUND)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = RangeStream(TaskContext.get().partitionId(), min_docs)
        for batch in batches:
            for row in batch.to_pylist():
                state.add(row)
                if len(state.out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(state.take(), schema=found_schema)
        if state.key is not None:
            state.end(last=True)
        yield pa.RecordBatch.from_pylist(state.take(), schema=found_schema)

    found = save_round(
        arrow_map(rows.repartitionByRange(*order).sortWithinPartitions(*order), stream, FOUND), "line-ranges")
    edges = found.where("kind = 'count'").groupBy("h1", "h2").agg(
        F.sum("n").alias("_docs"), F.min("part").alias("_first"))
    waiting = found.where("kind = 'wait'").join(edges, ["h1", "h2"])
    if min_docs is None:
        waiting = waiting.withColumn("drop", F.expr(
            "if(part > _first, drop, slice(drop, 2, greatest(size(drop) - 1, 0)))"))
    else:
        waiting = waiting.where(F.col("_docs") >= min_docs)
    columns = ["doc_id", "body", "drop", "n_lines"]
    drops = found.where("kind = 'drop'").select(*columns).union(waiting.select(*columns)).where("size(drop) > 0")
    of_document = drops.groupBy("doc_id", "body").agg(
        F.flatten(F.collect_list("drop")).alias("drop"), F.max("n_lines").alias("n_lines"))

    def pack(some: dict) -> dict:
        out: dict[str, list] = {"doc_id": some["doc_id"], "body": some["body"], "n_lines": some["n_lines"],
                                "n_dropped": [], "keep": []}
        for drop, n in zip(some["drop"], some["n_lines"]):
            bits = np.ones(n, bool)
            bits[drop] = False
            out["n_dropped"].append(int(n - bits.sum()))
            out["keep"].append(zlib.compress(np.packbits(bits).tobytes()))
        return out

    return text_rows(of_document, "doc_id bigint, body bigint, n_lines bigint, n_dropped bigint, keep binary", pack)


def kept_lines(text: str, keep: bytes | None) -> str:
    """The text's kept lines, joined by line feeds."""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits.tolist()) if bit)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, keep, n_dropped): ``docs`` packed in ``row``, with its bitmap or NULL."""
    held = packed(docs, F.col("doc_id").cast("bigint").alias("_id"),
                  F.xxhash64(F.col("text").cast("string")).alias("_body"))
    marks = bitmaps.select(F.col("doc_id").alias("_mark"), F.col("body").alias("_marked"), "keep", "n_dropped")
    return held.join(marks, F.col("_id").eqNullSafe(F.col("_mark")) & (F.col("_body") == F.col("_marked")), "left")


@F.pandas_udf(StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([t and kept_lines(t, k) for t, k in zip(text, keep)], dtype=object)


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with their kept lines as ``text``; NULL stays NULL, and ``n_chars``, if there, is the new length."""
    ship(docs.sparkSession)
    joined = with_bitmaps(docs, bitmaps)
    kept = joined.select("row", F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(
        _kept(F.col("row.text"), F.col("keep"))).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    def digest(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "n_lines": [(t or "").count("\n") + 1 for t in rows["text"]],
                "n_dropped": [n or 0 for n in rows["n_dropped"]],
                "kept_sha256": [sha256(kept_lines(t or "", k).encode()).hexdigest()
                                for t, k in zip(rows["text"], rows["keep"])]}

    joined = with_bitmaps(keyed_text(docs), keep_bitmaps(docs, min_docs)).select("row.*", "keep", "n_dropped")
    return text_rows(joined, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string", digest)
