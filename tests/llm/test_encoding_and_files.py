"""Tokens, token files, mixing and shards against the public libraries and brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonehour.llm import bpe, mixing, sharding, token_files
from zonehour.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "A,b's 'S it'so ,'s", "x" * 5000, "é́É İ ß ÷ ǅ\x1c\x85　 z", "１２ 34.5 中文 😀",
       "<|endoftext|> word", "tab\tand  two   three\r\n end "]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with NULL and repeated ids, odd texts, and extra columns whose names operators use themselves."""
    rows = [(i if i % 3 else None, t, f"s{i % 2}" if i else None, i) for i, t in enumerate(ODD)]
    rows += [(4, "same", "s0", 1), (4, "same", "s0", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, ids int").withColumn(
        "_rank", F.lit("x")).withColumn("shard", F.lit(3)).withColumn("start", F.lit(0))


def empty(df):
    return df.where("false")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_op9_equals_the_public_library(spark, texts, library):
    for row in QUERIES["op9_byte_bpe"](spark, SF_DIR).collect():
        want = library[0].encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_encoding_of_odd_rows(spark, odd, library):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_documents(odd, path, public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in got) == sorted((d or -1, t) for d, t in want)
    by_text = {bytes(r.decoded).decode(): np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got}
    assert all(by_text[t] == library[0].encode_ordinary(t) for _, t in want)
    assert bpe.encode_documents(empty(odd), path, public_tokenizers.PATTERN).count() == 0


def test_fits_equals_merging(library):
    pairs, rnd = bpe.BytePairs(library[1]), random.Random(3)
    tokens = list(library[1].values())
    for i in range(20_000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        if i % 2:
            whole = pairs.bytes_of[a]
            cut = rnd.randrange(len(whole) + 1)
            a, b = library[1].get(whole[:cut], a), library[1].get(whole[cut:], b)
        joined = [pairs.bytes_of[a], pairs.bytes_of[b]]
        assert pairs.fits(a, b) == (pairs.merged(b"".join(joined)) == joined)


def test_appends_and_edits_equal_a_new_encoding(library):
    pairs, rnd = bpe.BytePairs(library[1]), random.Random(4)
    for _ in range(150):
        word = lambda n: bytes(rnd.choice(b"thein ioner") for _ in range(rnd.randrange(n)))
        state = bpe.PrefixEncoding(pairs, word(300))
        state.append(more := word(9))
        assert state.tokens() == bpe.PrefixEncoding(pairs, state.data).tokens() and state.data.endswith(more)
        start = rnd.randrange(len(state.data) + 1)
        stop = min(len(state.data), start + rnd.randrange(6))
        state.replace(start, stop, word(6))
        fresh = bpe.PrefixEncoding(pairs, state.data)
        assert state.last == fresh.last and state.tokens() == fresh.tokens()


def test_an_edit_computes_its_neighbourhood_only(library):
    pairs = bpe.BytePairs(library[1])
    state = bpe.PrefixEncoding(pairs, b"therein" * 2000)
    assert state.replace(5000, 5003, b"xyz") < 300


def test_op7_equals_the_tokenizers_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, got = 0, {r.doc_id: r for r in QUERIES["op7_token_files"](spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for doc_id in sorted(texts):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids + [1]
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    manifest = token_files.write_token_files(odd, str(tmp_path / "a"), path, 1)
    got = token_files.read_token_files(manifest, str(tmp_path / "a")).orderBy("start").collect()
    key = lambda d: -1 if d is None else d
    assert [key(r.doc_id) for r in got] == sorted(key(r.doc_id) for r in odd.collect())
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [1]))
                   for r in odd.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == want
    some = token_files.read_token_files(manifest, str(tmp_path / "a"), [4, 7, 99]).collect()
    assert sorted(r.doc_id for r in some) == [4, 4, 4, 7]
    none = token_files.write_token_files(empty(odd), str(tmp_path / "b"), path, 1)
    assert token_files.read_token_files(none, str(tmp_path / "b")).count() == 0


def test_token_files_of_capitals_before_marks(spark, tmp_path):
    """A small letter and a mark may compose where the capital and the mark don't: case matters until NFC is done."""
    texts = ["J\u030c H\u0331 T\u0308 W\u030a Y\u030a", "j\u030c h\u0331", "xJ\u0323\u030cx, E\u0301 ÀÞ× É÷", "I\u0307 \u0130"]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    manifest = token_files.write_token_files(docs, str(tmp_path / "a"), path, 1)
    for row in token_files.read_token_files(manifest, str(tmp_path / "a")).collect():
        want = library.encode(texts[row.doc_id], add_special_tokens=False).ids + [1]
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == want


def test_op7_takes_special_tokens_as_the_library_does(spark, tmp_path):
    texts = ["a <|endoftext|> b", "x<|startoftext|>y,<|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "J\u030c<|endoftext|>É z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in QUERIES["op7_token_files"](spark, str(tmp_path)).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids + [1]
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_missing_parts_go_to_the_library_in_one_call(monkeypatch):
    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(7)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    signs = "abJTé\u00c9\u00d7\u00f7\u030c\u0308'st09 \n\x1c.,!<|>中"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(80))) + " often" for _ in range(300)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words, asked = token_files.WordIds(path), []
    ask = words.model_ids
    monkeypatch.setattr(words, "model_ids", lambda parts: asked.append(parts) or ask(parts))
    assert words.encode([t.encode() for t in texts]) == want
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    # tables that start anew, and texts in pieces, give the same; a frequent part isn't asked for again
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 100)
    asked.clear()
    assert [words.encode([t.encode()])[0] for t in texts] == want
    assert sum(b"often" in parts for parts in asked) == 0 and len(words.new) < 300
    monkeypatch.setattr(token_files, "AT_ONCE", 10)
    assert words.encode([t.encode() for t in texts]) == want
    assert words.encode([b"a\xff\xc3 b\xc3", b" ", b""])[1:] == [b"", b""]


def test_token_file_is_seekable_zstandard_and_finds_damage(tmp_path):
    from pyarrow.fs import LocalFileSystem

    name = str(tmp_path / "x.tokens")
    with open(name, "wb") as f:
        out = token_files.FrameWriter(f)
        out.add(3, b"abcd" * 50)
        out.add(None, b"efgh")
        out.close()
    with open(name, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"abcd" * 50 + b"efgh"
    frames = token_files.FrameReader(LocalFileSystem().open_input_file(name))
    assert frames.ids(1) == b"efgh" and frames.doc_ids[0] == 3 and frames.void.tolist() == [False, True]
    raw = bytearray(open(name, "rb").read())
    raw[-30] ^= 1  # in the seek table
    open(name, "wb").write(raw)
    with pytest.raises((ValueError, OSError)):
        bad = token_files.FrameReader(LocalFileSystem().open_input_file(name))
        [bad.ids(i) for i in range(2)]


def brute_schedule(weights, slots):
    total, done, out = sum(weights.values()), Counter(), []
    for slot in range(slots):
        ready = [s for s in weights if done[s] * total // weights[s] <= slot]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), str(s)))
        out.append((s, done[s]))
        done[s] += 1
    return out


def in_order(placed):
    return [(s, i) for _, s, i in sorted((slot, s, i) for s, taken in placed.items() for i, slot in enumerate(taken))]


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 0.9, "b": 0.1}, {"a": 5, "b": 3, "c": 2, "": 0.001},
                                     {"big": 50, **{f"s{i}": 5 for i in range(10)}}, {f"s{i}": i + 1 for i in range(25)}])
def test_schedule_is_less_than_a_block_off(weights):
    exact = {s: Fraction(w) for s, w in weights.items()}
    order = in_order(mixing.schedule(weights, {s: 7 for s in weights}))
    assert order == brute_schedule(exact, len(order))
    done, total = Counter(), sum(exact.values())
    for slot, (s, _) in enumerate(order, 1):
        done[s] += 1
        assert all(abs(exact[x] * slot / total - done[x]) < 1 for x in exact)
    assert min(done.values()) == 7 and Counter(s for s, _ in order[:-1])[order[-1][0]] == 6


@pytest.mark.parametrize("counts", [{"huge": 10**7, "one": 1}, {f"s{i}": 1 + i * i % 997 for i in range(5000)}])
def test_rare_and_many_sources_keep_their_exact_weights(counts):
    weights = mixing.default_weights(counts)
    rows = mixing.rows_of_block(counts, weights)
    placed = mixing.schedule(weights, {s: -(-n // rows) for s, n in counts.items()})
    total, slots = sum(weights.values()), sum(map(len, placed.values()))
    assert slots <= 2 * mixing.SLOTS
    for s, taken in placed.items():  # each block within its window keeps the source less than a block off at every slot
        part, last = weights[s] / total, len(taken) - 1
        for i in sorted({0, 1, 2, last // 2, last - 1, last} & set(range(len(taken)))):
            assert i / part - 1 < taken[i] < (i + 1) / part
        assert abs(len(taken) - part * slots) < 1
    if "huge" in counts:
        assert 50 < len(placed["one"]) * rows < 200


def test_blocks_grow_only_when_the_schedule_would():
    assert mixing.rows_of_block({"a": 10**6, "b": 10}, {"a": 1, "b": 1}) == mixing.BLOCK_ROWS
    rows = mixing.rows_of_block({"a": 10**12, "b": 10}, {"a": 3, "b": 1})
    assert rows * mixing.SLOTS >= 4 * 10**12 // 3 > (rows - 1) * mixing.SLOTS


def test_op5_against_its_definition(spark, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op5_pfair_mixing"](spark, SF_DIR).collect()
    counts = Counter(source.values())
    assert {r.doc_id for r in rows if r.mix_epoch == 0} == set(source)
    slots = {}
    for r in rows:
        assert r.source == source[r.doc_id]
        slots.setdefault(r.mix_slot, []).append(r)
    assert sorted(slots) == list(range(len(slots)))
    order = brute_schedule({s: Fraction(round(n ** 0.7 * 1e6), 10**6) for s, n in counts.items()}, len(slots))
    for slot, block in slots.items():
        assert {(r.source, r.mix_block) for r in block} == {order[slot]}
        assert sorted(r.mix_place for r in block) == list(range(mixing.BLOCK_ROWS))
    for s, n in counts.items():
        ring = [r.doc_id for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.mix_slot, r.mix_place))]
        assert len(set(ring[:n])) == n and all(ring[i] == ring[i - n] for i in range(n, len(ring)))


def test_mixing_of_odd_rows(spark, odd):
    out = mixing.mixed_documents(odd, block_rows=2, weights={"s0": 1, "s1": 2, None: 1})
    assert out.columns == odd.columns
    given, got = Counter(map(tuple, odd.collect())), Counter(map(tuple, out.collect()))
    assert set(given) == set(got) and all(got[k] >= given[k] for k in given)
    assert mixing.mix(empty(odd)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, weights={"s0": 1})
    with pytest.raises(ValueError):
        mixing.mix(odd, weights={"s0": 1, "s1": 0, None: 1})


def test_mixing_of_more_sources_than_a_chunk(spark):
    rows = [(i, f"s{i % 1500}", "t") for i in range(3000)] + [(i, "big", "t") for i in range(3000, 8000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_rows=2).collect()
    assert {r.doc_id for r in got if r.mix_epoch == 0} == set(range(8000))
    counts = Counter(s for _, s, _ in rows)
    order = in_order(mixing.schedule(mixing.default_weights(counts), {s: -(-n // 2) for s, n in counts.items()}))
    assert sorted({(r.mix_slot, r.source, r.mix_block) for r in got}) == [(t, s, i) for t, (s, i) in enumerate(order)]
    assert len(got) == 2 * len(order)


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    return by


def test_op6_against_brute_force(spark, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op6_stratified_shards"](spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None
    check_shards(rows, 40)
    placed = [source[r.doc_id] for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    n, seen, fractions = Counter(placed), Counter(), []
    for s in placed:  # the order is by fractional rank
        fractions.append((Fraction(2 * seen[s] + 1, 2 * n[s]), s))
        seen[s] += 1
    assert fractions == sorted(fractions)


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    by, n = check_shards(sharding.shard_rows(docs, 10, 1).collect(), 10), Counter(r[2] for r in rows)
    assert all(abs(Counter(r.source for r in part)[s] - n[s] / 10) <= 2 for part in by.values() for s in n)


def test_shards_of_odd_rows(spark, odd, tmp_path):
    rows = sharding.shard_rows(odd, 4).collect()
    check_shards(rows, 4)
    keep = [c for c in odd.columns if c != "shard"]
    assert Counter(tuple(r[c] for c in keep) for r in rows) == Counter(map(tuple, odd.select(*keep).collect()))
    assert sharding.shard_rows(empty(odd), 4).count() == 0
    sharding.write_shards(odd, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_ranks_dont_depend_on_the_cells(spark, monkeypatch):
    from zonehour.llm import common

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "h").alias("g"))
    drawn = docs.withColumn("_o", common.seeded(1, "doc_id"))
    whole = {r.doc_id: r.r for r in common.rank_within(drawn, ["g"], "_o", ["doc_id"], "r").collect()}
    monkeypatch.setattr(common, "CELL_ROWS", 40)
    cut = {r.doc_id: r.r for r in common.rank_within(drawn, ["g"], "_o", ["doc_id"], "r").collect()}
    assert whole == cut and sorted(cut.values())[-1] == 1999
