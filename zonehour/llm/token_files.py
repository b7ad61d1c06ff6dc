"""Token ids in binary files of independent zstandard frames, with a seek table at the end.

A file holds the documents of one range of doc_id, in ascending order, one frame each, so a reader
decompresses only what it is asked for. Layout, all numbers little-endian:

- a zstandard frame for each document (with the library's own content checksum), the ids as unsigned
  32-bit integers;
- a skippable frame (magic 0x184D2A50) with the doc_id of every frame: 8 bytes each, then one byte each
  that is 1 where doc_id is NULL;
- a skippable frame (magic 0x184D2A5E) in the public seekable format: for every frame before it the
  compressed size, the decompressed size and the low 32 bits of the content's XXH64; then the number of
  frames, a descriptor byte (0x80: with checksums) and the magic 0x8F92EAB1.

Files are written under a name of their own by each attempt and then renamed, so a task that runs again
after an executor is lost replaces its file by an equal one.
"""

import functools
import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .common import ASCII_SPACE, arrow_map, arrow_schema, keyed_text, slices

#: Fixed values of the public seekable format.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_LIMIT = (1 << 32) - 1

MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"
TOKENS = "doc_id bigint, start bigint, ids binary"

#: A worker keeps the ids of two generations of parts, each of so many entries (about 40 MB) or so many bytes of keys.
CACHE_ENTRIES, CACHE_BYTES = 300_000, 8 << 20
#: Bytes of texts that are encoded together.
AT_ONCE = 2 << 20

SPACE, LETTER, SIGN, DIGIT, ODD = range(5)
WHITE = re.compile(rb"[ \t-\r]")
#: Kind of each ASCII character in lower case; the apostrophe is odd, since letters may belong to it.
KIND = np.full(256, ODD, np.uint8)
KIND[list(ASCII_SPACE.encode())] = SPACE
KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
KIND[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = SIGN
KIND[list(b"0123456789")] = DIGIT
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: UTF-8 of U+00C0 to U+00FF is this byte and one of 0x80 to 0xBF: small letters from 0x9F on, capitals 0x20 before
#: theirs, and two signs (U+00D7, U+00F7).
LATIN, LATIN_LOWER, LATIN_LETTER = 0xC3, LOWER.copy(), np.zeros(256, bool)
LATIN_LOWER[0x80:0x9F] += 0x20
LATIN_LOWER[0x97] = 0x97
LATIN_LETTER[0x80:0xC0] = True
LATIN_LETTER[[0x97, 0xB7]] = False


class WordIds:
    """Little-endian ids of texts, by the tokenizers library.

    The tokenizer drops white space, lower-cases, and cuts words into runs of letters, single digits and
    runs of other signs, so a text's ids are those of these parts in turn. A word that has only ASCII
    characters but the apostrophe, and letters from U+00C0 to U+00FF, needs no normalisation: it is cut
    here, and parts that aren't known go to the library's model in one call. Any other word is one part
    as it stands and goes through the whole tokenizer. So does a word with an added token, unless
    ``encode_special_tokens`` takes special ones as text.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        self.new, self.old, self.size = {}, {}, 0
        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole.encode_special_tokens, self.model.encode_special_tokens = encode_special_tokens, True
        self.added = [re.compile(re.escape(token.content.encode())) for token in
                      self.whole.get_added_tokens_decoder().values() if not (token.special and encode_special_tokens)]
        letters = "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
        assert unicodedata.is_normalized("NFC", letters)
        # the model knows a byte by its code point, or else by the one that the pre-tokenizer gives it
        mapped = {c.encode().decode("latin-1"): self.whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.others = [(c[1], to[1]) for c, to in mapped.items() if c != to]
        self.model.normalizer, self.model.pre_tokenizer = None, CharDelimiterSplit("\n")
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. A long one is cut at white space, so that not all of its parts are held at once."""
        if max(map(len, texts), default=0) > AT_ONCE:
            return [b"".join(ids for some in cut(text) for ids in self.encode_short([some])) for text in texts]
        return self.encode_short(texts)

    def encode_short(self, texts: list[bytes]) -> list[bytes]:
        parts, places, odd = split(b" ".join(texts), self.added)
        if not len(parts):
            return [b""] * len(texts)
        coded = parts.dictionary_encode()
        whole = np.zeros(len(coded.dictionary), bool)
        whole[coded.indices.to_numpy()[odd]] = True
        ids = pa.array(self.known(coded.dictionary.to_pylist(), whole), pa.binary()).take(coded.indices)
        starts, data = np.frombuffer(ids.buffers()[1], np.int32)[:len(parts) + 1], ids.buffers()[2].to_pybytes()
        ends = starts[np.searchsorted(places, np.cumsum([len(text) + 1 for text in texts]))].tolist()
        return [data[at:end] for at, end in zip([0, *ends], ends)]

    def known(self, parts: list[bytes], whole: np.ndarray) -> list[bytes]:
        """The ids of different parts; frequent parts move on from generation to generation."""
        new, old, missing = self.new, self.old, []
        ids = list(map(new.get, parts))
        for i in [i for i, known in enumerate(ids) if known is None]:
            part = parts[i]
            if part in old:
                ids[i] = new[part] = old[part]
            elif whole[i]:
                text = part.decode("utf-8", "replace")
                ids[i] = new[part] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                missing.append(i)
            self.size += len(part)
        if missing:
            for i, found in zip(missing, self.model_ids([parts[i] for i in missing])):
                ids[i] = new[parts[i]] = found
        if len(new) > CACHE_ENTRIES or self.size > CACHE_BYTES:
            self.old, self.new, self.size = new, {}, 0
        return ids

    def model_ids(self, parts: list[bytes]) -> list[bytes]:
        """Each part's last token, and no other, has the model's mark for the end of a word."""
        text = b"\n".join(parts).decode("latin-1")
        for byte, char in self.others:
            text = text.replace(byte, char)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends, data = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), ids.tobytes()
        if len(ends) != len(parts):
            raise ValueError(f"{len(parts)} parts have {len(ends)} ends")
        return [data[at:end] for at, end in zip([0, *ends], ends)]


def split(text: bytes, added: Iterable[re.Pattern]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts, the place where each begins, and whether it is a word that stays whole (and keeps its capitals)."""
    raw = np.frombuffer(text, np.uint8)
    low = LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == LATIN)
    low[lead + 1] = LATIN_LOWER[raw[lead + 1]]
    kind = KIND[low]
    letter = lead[LATIN_LETTER[raw[lead + 1]]]
    kind[letter] = kind[letter + 1] = LETTER
    for token in added:
        for found in token.finditer(text):
            kind[found.start():found.end()] = ODD
    inside = kind != SPACE
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        words = np.unique(np.searchsorted(begin, odd, "right") - 1)
        steps = np.zeros(len(raw) + 1, np.int8)
        steps[begin[words]], steps[end[words]] = 1, -1
        whole = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
        np.copyto(low, raw, where=whole)
        kind[whole] = ODD
    first = inside & (kind != np.append(np.uint8(SPACE), kind[:-1])) | (kind == DIGIT)
    places, data = np.flatnonzero(first), low[inside]
    starts = np.append(np.flatnonzero(first[inside]), len(data)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(starts), pa.py_buffer(data)])
    return parts, places, kind[places] == ODD


def cut(text: bytes) -> Iterator[bytes]:
    """Pieces of ``AT_ONCE`` bytes, each up to the white space that follows."""
    at = 0
    while space := WHITE.search(text, at + AT_ONCE):
        yield text[at:space.start()]
        at = space.start()
    yield text[at:]


@functools.lru_cache(maxsize=2)
def word_ids(path: str, encode_special_tokens: bool) -> WordIds:
    """One per worker process and vocabulary. The library keeps to the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path, encode_special_tokens)


class FrameWriter:
    """Appends documents to an open binary stream; ``close`` adds the index and the seek table."""

    def __init__(self, stream):
        self.stream, self.doc_ids, self.entries, self.n_tokens, self.n_bytes = stream, [], [], 0, 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        if max(len(ids), len(frame)) > FRAME_LIMIT:
            raise ValueError(f"document {doc_id} has more ids than a frame of the format can hold")
        self._put(frame)
        self.doc_ids.append(doc_id)
        self.entries.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        index = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + bytes(d is None for d in self.doc_ids)
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append(struct.pack("<III", len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, FOOTER_MAGIC)
        self._put(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Finds documents by the seek table and the index; a damaged file or frame is an error."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a token file: the footer is missing")
        self.table = np.frombuffer(self._read(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3)
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self._read(int(self.places[-2]) + 8, int(self.table[-1, 0]) - 8)
        self.doc_ids = np.frombuffer(index[:8 * (count - 1)], "<i8")
        self.void = np.frombuffer(index[8 * (count - 1):], bool)
        self.lengths = self.table[:-1, 1] // 4
        self.zstd = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("the file ends within a frame")
        return data

    def ids(self, frame: int) -> bytes:
        size, length, check = map(int, self.table[frame])
        ids = self.zstd.decompress(self._read(int(self.places[frame]), size), max_output_size=length)
        if len(ids) != length or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame} doesn't match its checksum")
        return ids


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                      encode_special_tokens: bool = True) -> DataFrame:
    """Encode all texts and write one file for each range of doc_id; the manifest has a row for each file.

    ``folder`` must be shared by all machines (a path, or a URI that pyarrow's file systems know). NULL
    and empty texts have the end id alone. NULL doc_id comes first. Rows with the same doc_id all stay,
    ordered by their text's hash. Columns besides doc_id and text are ignored; an empty table gives files
    without frames, or none. The only shuffle deals texts by ranges of (doc_id, hash), so many
    rows with one doc_id are split too. The manifest, one row a file, is written beside the files.
    ``encode_special_tokens`` is the library's switch: words of a text that read like special tokens
    (``<|endoftext|>``) are text, or else, as by the library's default, those tokens.
    """
    ordered = (
        keyed_text(docs).withColumn("_tie", F.xxhash64("text"))
        .withColumn("text", F.col("text").cast("binary"))
        .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    )
    manifest = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        words = word_ids(tokenizer_path, encode_special_tokens)
        place, root = FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        path, draft = f"{root}/part-{part:06d}.tokens", f"{root}/_draft-{part:06d}-{uuid.uuid4().hex}"
        with place.open_output_stream(draft) as stream:
            out = FrameWriter(stream)
            for batch in batches:
                for some in slices(batch, AT_ONCE):
                    texts = [text or b"" for text in some["text"].to_pylist()]
                    for doc_id, ids in zip(some["doc_id"].to_pylist(), words.encode(texts)):
                        out.add(doc_id, ids + end)
            out.close()
        place.move(draft, path)
        yield pa.RecordBatch.from_pylist([{
            "part": part, "path": f"part-{part:06d}.tokens", "n_docs": len(out.doc_ids), "n_tokens": out.n_tokens,
            "n_bytes": out.n_bytes}], schema=manifest)

    arrow_map(ordered, write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) from the files: of all documents, or of a short list of ``doc_ids`` only.

    ``start`` is the number of ids in all documents before. Frames of other documents aren't decompressed.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    wanted = None if doc_ids is None else np.unique(np.array(list(doc_ids), np.int64))
    tokens = arrow_schema(TOKENS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist()):
                with place.open_input_file(f"{root}/{name}") as source:
                    frames = FrameReader(source)
                    starts = first + np.cumsum(frames.lengths, dtype=np.int64) - frames.lengths
                    which = range(len(starts)) if wanted is None else np.flatnonzero(
                        np.isin(frames.doc_ids, wanted) & ~frames.void)
                    rows, size = [], 0
                    for i in which:
                        ids = frames.ids(i)
                        rows.append({"doc_id": None if frames.void[i] else int(frames.doc_ids[i]),
                                     "start": int(starts[i]), "ids": ids})
                        size += len(ids)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=tokens)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=tokens)

    return arrow_map(files.repartition(max(1, manifest.count()), "part"), read, TOKENS)


def file_digests(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                 encode_special_tokens: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``write_token_files`` wrote, read back from the files."""
    manifest = write_token_files(docs, folder, tokenizer_path, end_id, encode_special_tokens)
    read = read_token_files(manifest, folder)
    return read.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
