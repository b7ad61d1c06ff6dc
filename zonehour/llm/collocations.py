"""Phrase collocations from a weighted de Bruijn graph of word windows.

A node is three neighbouring words of a piece, an edge four; an edge joins the nodes of its first and its
last three words, and its weight is how often it occurs. Windows that end early are kept as corrections.
Everything shorter follows from the graph: a node occurs as often as its outgoing edges weigh, plus the
windows that end in it; two words occur as often as the nodes that begin with them, plus the windows
that end in them; and so on. So windows are counted once per position.

A window ends early at its piece's end, and before a pair of words that is too rare for any wanted
phrase. Which pairs may be frequent is read from a table of counters that is made first: pairs are dealt
to 2 ** PAIR_BITS counters by a hash, and a counter below the threshold proves all its pairs rare. A
counter that reaches it by chance only leaves windows longer than needed, so counts are exact at every
size; the table never grows, and once it is full nothing is left out.

Edges that follow each other through nodes without any other traffic weigh the same. Such unary paths
are compacted into one row: a long phrase and its weight, from which its edges are read again.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_round, save_round
from .common import arrow_map, arrow_schema, slices

#: Words of an edge.
LONGEST = 4
#: Characters that end a piece, and the white space inside one.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Stands for every break: a byte that UTF-8 never has.
BREAK = b"\xff"
CLEAN = bytes.maketrans(bytes(range(65, 91)) + BREAKS + BLANKS, bytes(range(97, 123)) + BREAK * len(BREAKS) + b" " * len(BLANKS))
#: The frequent pairs are told apart by so many bits: 16 MB of them are sent to every worker, whatever the input.
PAIR_BITS = 27
#: Bits in a row of the assembled table, fixed by the engine's bitmap functions.
ROW_BITS = 1 << 15
#: Bytes of text that are counted together.
SLICE_BYTES = 4 << 20

PAIRS, GRAMS = "slot int, n bigint", "lang string, gram string, n bigint"


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, ids) for each lang of a batch: the words in reading order by their number, 0 between pieces."""
    texts = defaultdict(list)
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
        if text:
            texts["und" if lang is None else lang].append(text)
    for lang, some in texts.items():
        clean = "\n".join(["", *some, ""]).encode().translate(CLEAN).replace(BREAK, b" \xff ").split()
        known = defaultdict(count().__next__)
        ids = np.fromiter(map(known.__getitem__, clean), np.int64, len(clean))
        yield lang, list(known), ids


def _pair_slots(lang: str, words: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Counter of the pair that begins at each word but the last; the hash is of the words and the lang."""
    seed = xxhash.xxh3_64_intdigest(lang)
    hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)[ids]
    mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _readable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def frequent_pairs(docs: DataFrame, least: int) -> bytes:
    """A bit for each counter: set if it holds ``least`` pairs or more. 2 ** PAIR_BITS / 8 bytes, always."""
    schema = arrow_schema(PAIRS)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                for lang, words, ids in _numbered(part):
                    inside = (ids[:-1] > 0) & (ids[1:] > 0)
                    slots, n = np.unique(_pair_slots(lang, words, ids)[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n)], schema=schema)

    full = arrow_map(_readable(docs), tally, PAIRS).groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = full.groupBy(F.expr(f"slot div {ROW_BITS}").alias("row")).agg(
        F.bitmap_construct_agg(F.col("slot") % ROW_BITS).alias("bits"))
    table = bytearray((1 << PAIR_BITS) // 8)
    for row, bits in rows.collect():  # at most 2 ** PAIR_BITS / ROW_BITS rows
        table[row * ROW_BITS // 8:(row + 1) * ROW_BITS // 8] = bits
    return bytes(table)


def windows(docs: DataFrame, pairs: bytes) -> DataFrame:
    """(lang, gram, n): the four words from each word on, or as many as there are before a piece ends or a rare pair comes."""
    schema, shared = arrow_schema(GRAMS), docs.sparkSession.sparkContext.broadcast(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                for lang, words, ids in _numbered(part):
                    grams, n = _counted_windows(bits, lang, words, ids)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), grams, pa.array(n)], schema=schema)

    return arrow_map(_readable(docs), cut, GRAMS)


def _counted_windows(bits: np.ndarray, lang: str, words: list[bytes], ids: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The windows of one lang's words in a batch, each once, and how often it is there."""
    slots = _pair_slots(lang, words, ids)
    on = np.zeros(len(ids) + LONGEST, bool)  # does the next word still belong to a window?
    on[:len(slots)] = (ids[:-1] > 0) & (ids[1:] > 0) & (bits[slots >> 3] >> (slots & 7) & 1).astype(bool)
    alone = np.bincount(ids[(ids > 0) & ~on[:len(ids)]], minlength=len(words))
    single = np.flatnonzero(alone)
    at = np.flatnonzero(on)
    columns, more = [ids[at]], on[at]
    padded = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
    for k in range(1, LONGEST):
        columns.append(np.where(more, padded[at + k], 0))
        more = more & on[at + k]
    pairs, where = np.unique(np.concatenate([columns[0] * len(words) + columns[1], columns[2] * len(words) + columns[3]]),
                             return_inverse=True)
    keys, n = np.unique(where[:len(at)] * len(pairs) + where[len(at):], return_counts=True)
    halves = [divmod(pairs[half], len(words)) for half in (divmod(keys, max(1, len(pairs))) if len(keys) else (keys, keys))]
    found = zip(*(column.tolist() for half in halves for column in half))
    text = [words[i] for i in single.tolist()] + [b" ".join([words[i] for i in gram if i]) for gram in found]
    return pa.array(text, pa.binary()).cast(pa.string()), np.concatenate([alone[single], n])


def _length(gram) -> Column:
    return F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1


def _flow(longer: DataFrame, words: int) -> DataFrame:
    """Counts of all phrases of ``words`` words: what leaves them, plus the windows that end in them.

    ``longer`` has the phrases of one word more, and the corrections; shorter corrections pass through.
    """
    return longer.groupBy("lang", F.substring_index("gram", " ", words).alias("gram")).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, gram, k, n): all phrases of k = 1 to 4 words found ``least`` times or more, and each lang's
    number of word occurrences as a row with k = 0 and gram NULL. Written to the shared folder.

    Counts are summed in each batch and map-side before they are shuffled, so frequent words and passages
    are one row a task. Phrases that aren't frequent have no use and may be counted in part only.
    """
    flows = {LONGEST: windows(docs, frequent_pairs(docs, least)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))}
    for k in range(LONGEST - 1, 0, -1):
        flows[k] = _flow(flows[k + 1], k)
    # One condition on count and length together: alone, the length would be tested before counting, and
    # Spark couldn't use one shuffle for both the frequent phrases and the next shorter counts.
    kept = [flow.where(F.when(F.col("n") >= least, _length("gram")).otherwise(0) == k)
            .select("lang", "gram", F.lit(k).alias("k"), "n") for k, flow in flows.items()]
    totals = flows[1].groupBy("lang").agg(F.sum("n").alias("n")).select(
        "lang", F.lit(None).cast("string").alias("gram"), F.lit(0).alias("k"), "n")
    out = totals
    for part in kept:
        out = out.unionByName(part)
    return save_round(out, "phrases")


def compacted(counts: DataFrame) -> DataFrame:
    """(lang, path, n): every unary path of the frequent edges as one phrase of four words or more.

    A node is passed by if one edge brings all its occurrences and one takes them all: both weigh as much
    as the node occurs. No cycle has such nodes only, since its text must begin somewhere. Each edge looks
    up its predecessor's predecessor, so paths of L edges take log2(L) rounds; every round is a written table.
    """
    nodes = counts.where(F.col("k") == LONGEST - 1).select("lang", F.col("gram").alias("node"), F.col("n").alias("flow"))
    edges = counts.where(F.col("k") == LONGEST).select("lang", "gram", "n")
    into = edges.select("lang", F.substring_index("gram", " ", 1 - LONGEST).alias("node"), F.col("gram").alias("before"), "n")
    out = edges.select("lang", F.substring_index("gram", " ", LONGEST - 1).alias("node"), "gram", "n")
    full = lambda side: side.join(nodes, ["lang", "node"]).where("n = flow").drop("n", "flow")
    links = full(out).join(full(into), ["lang", "node"]).drop("node")
    state = save_round(edges.join(links, ["lang", "gram"], "left").select(
        "lang", "gram", "n", F.coalesce("before", "gram").alias("head"),
        F.col("before").isNotNull().cast("bigint").alias("steps")), "paths")
    while True:
        heads = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("far"), F.col("steps").alias("more"))
        moved = save_round(state.where("steps > 0").join(heads, ["lang", "head"]).select(
            "lang", "gram", "n", F.col("far").alias("head"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("more") > 0).alias("open")).unionByName(state.where("steps = 0").withColumn("open", F.lit(False))), "paths")
        drop_round(state)
        state = moved.drop("open")
        state._zonehour_path = moved._zonehour_path
        if moved.where("open").isEmpty():
            break
    tail = F.transform(F.sort_array(F.collect_list(F.when(F.col("steps") > 0, F.struct(
        "steps", F.substring_index("gram", " ", -1).alias("word"))))), lambda x: x["word"])
    return state.groupBy("lang", "head", "n").agg(tail.alias("tail")).select(
        "lang", F.concat_ws(" ", "head", "tail").alias("path"), "n")


def spelled(paths: DataFrame) -> DataFrame:
    """(lang, gram, n): the edges of compacted paths."""
    words = paths.select("lang", F.split("path", " ").alias("words"), "n")
    return words.select("lang", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - (LONGEST - 1)),
        lambda i: F.array_join(F.slice("words", i, LONGEST), " "))).alias("gram"), "n")


def scored(counts: DataFrame, paths: DataFrame, inside: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates that no longer candidate covers.

    Of all cuts the lowest score counts, then the first cut. A phrase is covered if a longer candidate
    that contains it occurs at least ``inside`` percent as often. Products are decimals of 38 digits.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    phrases = counts.where(f"k BETWEEN 2 AND {LONGEST - 1}").select("lang", "gram", "n", "k").unionByName(
        spelled(paths).withColumn("k", F.lit(LONGEST)))
    cuts = phrases.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).selectExpr(
        "lang", "gram", "n", "cut", "substring_index(gram, ' ', cut) AS first", "substring_index(gram, ' ', cut - k) AS rest")
    parts = counts.where("k > 0")
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(n AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0)) div "
                   "(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "gram", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = phrases.where("k > 2").withColumn("size", F.explode(F.expr("sequence(2, k - 1)")))
    longer = longer.withColumn("at", F.explode(F.expr("sequence(size, k)"))).selectExpr(
        "lang", "substring_index(substring_index(gram, ' ', at), ' ', -size) AS gram", "n")
    longer = longer.groupBy("lang", "gram").agg(F.max("n").alias("longest"))
    kept = lowest.join(longer, ["lang", "gram"], "left").where(
        F.col("longest").isNull() | (wide("longest") * 100 < wide("n") * inside))
    return kept.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"),
                       F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases of 2 to 4 words by score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its two parts, ``n`` all words of the lang.
    Ordered by score and a descending, then the phrase's bytes. NULL texts have no words, a NULL lang is
    `und`, repeated rows count again, columns besides lang and text are ignored, an empty table gives no rows.
    Each task passes on its own first ``top`` rows of a lang, so no task gets all rows of a large one.
    """
    counts = phrase_counts(docs, least)
    kept = scored(counts, compacted(counts), inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = counts.where("k = 0").select("lang", "n")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def long_phrases(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, path, n): maximal phrases of four or more words that occur ``least`` times and always together."""
    return compacted(phrase_counts(docs, least))
