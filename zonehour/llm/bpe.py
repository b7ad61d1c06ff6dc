"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. The table of
these last tokens is all the state there is: the encoding of any prefix is read off backwards, more
bytes extend the table without touching it (exact appends), and after an edit the table is computed
anew only until it agrees with the old one again.

A token may follow another if plain merging of their joined bytes gives just these two tokens; a
sequence whose neighbours all fit is the encoding of its bytes.
"""

import base64
import functools
import hashlib
import re
import sys
from array import array

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import keyed_text, text_rows

#: Unicode's White_Space characters.
WHITE = "\t-\r \x85\xa0  -     　"
#: Text falls apart before each run of white space that follows other characters: no match of the
#: splitting pattern crosses such a place, so the parts are encoded alone and looked up again.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Entries that a worker's look-up tables hold at most before they start anew (about 100 MB).
CACHE_ENTRIES = 300_000
#: The same where ids and decoded bytes are held and written too, and the bytes of text encoded together there.
FULL_ENTRIES, SLICE_BYTES = 100_000, 2 << 20
#: Later than any merge.
FOREVER = 1 << 40


class BytePairs:
    """Merge ranks, and which tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self.longest = max(map(len, ranks), default=0)
        self._fits: dict[int, bool] = {}
        self._sides: dict[int, tuple[list, list] | None] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first, leftmost first, down to ``stop`` parts: for short strings."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def sides(self, token: int) -> tuple[list, list] | None:
        """How a token's last part, and its first, grow while it is merged: (bytes, made at, gone at).

        A part lives from its own rank to the rank of the merge that takes it in; bytes are there from
        the start. None: merging the token's bytes doesn't give the token.
        """
        if token in self._sides:
            return self._sides[token]
        data, found = self.bytes_of[token], None
        if len(data) == 1:
            found = ([(data, -1, FOREVER)], [(data, -1, FOREVER)])
        else:
            parts = self.merged(data, 2)
            if len(parts) == 2:
                left, right = (self.sides(self.ranks[p]) for p in parts)
                if left and right and token > max(self.ranks[p] for p in parts):
                    own = (data, token, FOREVER)
                    found = tuple([*([(d, m, min(g, token)) for d, m, g in side]), own]
                                  for side in (right[0], left[1]))
        self._sides[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Can ``right`` follow ``left``? ``left`` -1: can ``right`` stand at the start?

        It can unless, while both are merged, the last part of ``left`` and the first part of ``right``
        make a token that comes before the merge that would take either in. Of equal merges the left goes first.
        """
        after = self.sides(right)
        if left < 0 or after is None:
            return after is not None
        before = self.sides(left)
        if before is None:
            return False
        for a, made_a, gone_a in before[0]:
            for b, made_b, gone_b in after[1]:
                if made_a < gone_b and made_b < gone_a:
                    rank = self.ranks.get(a + b)
                    if rank is not None and rank < gone_a and rank <= gone_b:
                        return False
        return True

    def extend(self, data: bytes, last: list[int]) -> None:
        """Append to ``last`` the last token of each longer prefix of ``data``."""
        known, have = self._fits, len(last)
        for at, (size, token) in self.ends.iter(data.decode("latin-1"), max(0, have - self.longest + 1)):
            if at != have or at < size - 1:  # found already, or before the part to add
                continue
            pair = (last[at - size] + 1 if size <= at else 0) << 32 | token
            fit = known.get(pair)
            if fit is None:
                if len(known) >= 2 * CACHE_ENTRIES:
                    known.clear()
                known[pair] = fit = self.fits((pair >> 32) - 1, token)
            if fit:
                last.append(token)
                have += 1
        if have < len(data):
            raise ValueError(f"no token of the vocabulary ends at byte {have}")

    def read_back(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of length ``end``."""
        at, tokens = len(last) if end is None else end, []
        while at:
            tokens.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return tokens[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """One piece; a piece that is a token is that token, as the public library has it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.read_back(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixEncoding:
    """One piece whose encoding is kept up to date under appends and edits."""

    def __init__(self, pairs: BytePairs, data: bytes = b""):
        self.pairs, self.data, self.last = pairs, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.pairs.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for bytes start..stop; returns how many prefixes were computed.

        A prefix's last token depends on as many prefixes before it as the longest token has bytes.
        Once so many in a row equal the old ones, all later ones do too.
        """
        longest, moved = self.pairs.longest, start + len(new) - stop
        data, old, last = self.data[:start] + new + self.data[stop:], self.last, self.last[:start]
        same = done = 0
        while len(last) < len(data):
            self.pairs.extend(data[:len(last) + 1], last)
            done += 1
            at = len(last) - 1 - moved
            touched = len(last) <= start + len(new) + longest
            same = same + 1 if not touched and 0 <= at < len(old) and old[at] == last[-1] else 0
            if same >= longest:
                last.extend(old[at + 1:])
        self.data, self.last = data, last
        return done

    def tokens(self) -> list[int]:
        return self.pairs.read_back(self.last)


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ChunkCache(dict):
    """Little-endian ids of the parts that ``CHUNK`` finds; starts anew when full."""

    def __init__(self, pairs: BytePairs, pattern: str, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.pairs, self.pieces, self.known, self.entries = pairs, regex.compile(pattern), {}, entries

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        out = []
        for piece in self.pieces.findall(chunk):
            ids = self.known.get(piece)
            if ids is None:
                if len(self.known) >= self.entries:
                    self.known.clear()
                ids = little_endian(self.pairs.encode(piece.encode()))
                self.known[piece] = ids
            out.append(ids)
        self[chunk] = joined = b"".join(out)
        return joined

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def chunk_cache(path: str, pattern: str, entries: int = CACHE_ENTRIES) -> ChunkCache:
    """One per worker process and vocabulary; it is kept between tasks."""
    return ChunkCache(BytePairs(load_ranks(path)), pattern, entries)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and their bytes.

    One output row for each input row, whatever repeats; NULL and empty texts have no ids and decode to
    nothing; NULL doc_id stays NULL; columns besides doc_id and text are ignored. No shuffle: a row's
    work depends on its text alone, and memory is bounded by the look-up tables and one batch.
    """
    def work(rows: dict) -> dict:
        cache = chunk_cache(ranks_path, pattern, FULL_ENTRIES)
        ids = [cache.encode(t or "") for t in rows["text"]]
        plain = [cache.pairs.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
        return {"doc_id": rows["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": plain}

    return text_rows(keyed_text(docs), "doc_id bigint, n_tokens bigint, ids binary, decoded binary", work, SLICE_BYTES)


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``, hashed where they are made."""
    def work(rows: dict) -> dict:
        cache = chunk_cache(ranks_path, pattern)
        out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in rows["text"]:
            ids = cache.encode(text or "")
            plain = cache.pairs.decode(np.frombuffer(ids, "<u4").tolist())
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(plain).hexdigest())
        return out

    return text_rows(keyed_text(docs), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                     work)
