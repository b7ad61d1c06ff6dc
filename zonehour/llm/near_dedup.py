"""Near-duplicate texts: ProbMinHash sketches of five-word shingles, banding, exact verification.

Every shingle of weight w is a Poisson process of rate w: its arrivals, a hash apart, each hit one register.
A register keeps the shingle that hits it first. Two texts agree in a register with their probability
Jaccard similarity. Arrivals come in ascending order, so a shingle stops as soon as its next arrival is
later than the latest first hit of all registers.

A shingle found c times weighs 1 + ln c. Two texts are linked if the exact probability Jaccard of these
weights is 0.8 or more, or the exact Jaccard similarity of their distinct shingles is: a passage repeated in
one of two texts neither makes nor hides a pair. Each measure has its sketch, one with the real weights and
one with all weights 1; both fall together unless a text repeats a shingle, and only such *uneven* texts
have the second. Bands of registers of both propose pairs from the same buckets.
Classes are the connected components of all links; no group is ever paired with itself as a whole:

1. equal word sequences are one text from the start;
2. in each bucket every text is compared with the bucket's least and greatest text; links make components;
3. only buckets that still hold several components are searched in full, in blocks of bounded size: texts of
   different components whose registers look similar are verified where they meet, and a link is passed on
   only if it joins components: a block of n texts gives less than n rows, however many pairs are alike.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonehour.operators.graph import connected_components
from zonehour.sources.shared import drop_round, save_round

from .common import arrow_map, arrow_schema, keyed_text, packed, slices

#: Words of a shingle; a shorter text is one shingle.
WORDS = 5
#: Bands and registers in each: a pair at 0.8 is missed with probability 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: A pair is a link from a similarity of 4/5 on; of distinct shingles: 9 * shared >= 4 * (n_a + n_b).
LEAST_SIMILARITY = 0.8
#: Pairs of a full search whose registers agree in less than this share, in both sketches, aren't verified
#: (a pair at 0.8 is passed over with probability 1e-8).
LEAST_AGREEMENT = 0.55
#: Texts of a bucket that are compared in one piece.
BLOCK = 2048
#: Texts whose registers are filled together.
TOGETHER = 400

#: Classes that hold more than one row in so many are joined by broadcast: there are fewer of them than this.
HOT_SHARE = 1000

SKETCH = "doc_id bigint, body bigint, node binary, n int, bands array<bigint>, registers binary, uneven binary"
SHINGLES = "node binary, n int, shingles binary, repeats binary"
PAIRS = "a binary, b binary"

#: Odd multipliers: of a shingle's words, and of the two rounds of mixing (fixed values of a public mixer).
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F], np.uint64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each shingle, in order, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    return mixed(sum(w[i:i + n] * PLACES[i] for i in range(WORDS)))


def distinct(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each is found."""
    return np.unique(shingle_hashes(words), return_counts=True)


def weight(times: np.ndarray) -> np.ndarray:
    """The weight of shingles found so many times."""
    return 1 + np.log(times)


def repeats(times: np.ndarray) -> bytes | None:
    """Places and numbers of the shingles found more than once; None if there are none."""
    place = np.flatnonzero(times > 1)
    return np.stack([place, times[place]], 1).astype("<u4").tobytes() if len(place) else None


def weights(n: int, repeated: bytes | None) -> np.ndarray:
    """The weights of a text's ``n`` shingles, from what ``repeats`` gave."""
    times = np.ones(n)
    if repeated is not None:
        places = np.frombuffer(repeated, "<u4").reshape(-1, 2)
        times[places[:, 0]] = places[:, 1]
    return weight(times)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact probability Jaccard similarity of two ascending sets with weights.

    It is the sum over shared d of 1 / sum over all e of max(wa[e] / wa[d], wb[e] / wb[d]). In the order of
    wa / wb the first ratio is the greater one from d on, so the inner sums are running sums.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(wa[i] / wb[j], kind="stable")
    x, y = wa[i][order], wb[j][order]
    from_a = wa.sum() - x.sum() + np.cumsum(x[::-1])[::-1]
    from_b = wb.sum() - y.sum() + np.cumsum(y) - y
    return float((1 / (from_a / x + from_b / y)).sum())


def alike(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> bool:
    """Whether the probability Jaccard is 0.8 or more, up to rounding."""
    return probability_jaccard(a, wa, b, wb) >= LEAST_SIMILARITY - 1e-9


def sketches(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers (texts x REGISTERS) of (shingles, weights): the shingle that hits each register first."""
    m, n = REGISTERS, len(texts)
    first, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    shingle = np.concatenate([s for s, _ in texts]) if n else np.empty(0, np.uint64)
    pace = 1 / np.concatenate([w for _, w in texts]) if n else np.empty(0)
    text = np.repeat(np.arange(n), [len(s) for s, _ in texts])
    at, turn = np.zeros(len(shingle)), 0
    while len(shingle):
        turn += 1
        draw = mixed(shingle + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = at - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) * pace
        open_ = at < first.reshape(n, m).max(1)[text]
        shingle, pace, text, at, draw = shingle[open_], pace[open_], text[open_], at[open_], draw[open_]
        place = text * m + ((mixed(draw) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, place, at)
        won = first[place] == at
        winner[place[won]] = shingle[won]
    return winner.reshape(n, m)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each text."""
    out = np.zeros((len(registers), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * PLACES[0]
    for i in range(ROWS):
        out = mixed(out + registers[:, i::ROWS])
    return out.view(np.int64)


def short(registers: np.ndarray) -> bytes:
    """The upper half of each register."""
    return (registers >> np.uint64(32)).astype("<u4").tobytes()


def sketch_documents(docs: DataFrame) -> DataFrame:
    """A row for each document: its text's hash ``body``, its word sequence's hash ``node``, bands and registers.

    ``uneven``: the registers by real weights, NULL if no shingle is repeated, since they are the same then.
    ``bands`` has those of both, and NULL for a band of the second that equals the first's.
    """
    schema = arrow_schema(SKETCH)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for big in slices(batch):
                for at in range(0, big.num_rows, TOGETHER):
                    part = big.slice(at, TOGETHER)
                    words = [(t or "").encode().split() for t in part["text"].to_pylist()]
                    texts = [distinct(w) for w in words]
                    registers = sketches([(s, np.ones(len(s))) for s, _ in texts])
                    bands = [b.tolist() if len(s) else [] for b, (s, _) in zip(band_hashes(registers), texts)]
                    second: list[bytes | None] = [None] * len(texts)
                    uneven = [i for i, (_, times) in enumerate(texts) if (times > 1).any()]
                    weighted = sketches([(texts[i][0], weight(texts[i][1])) for i in uneven])
                    for i, own, marks in zip(uneven, band_hashes(weighted).tolist(), weighted):
                        bands[i] = bands[i] + [b if b != c else None for b, c in zip(own, bands[i])]
                        second[i] = short(marks)
                    yield pa.RecordBatch.from_arrays([
                        part["doc_id"], part["body"],
                        pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                        pa.array([len(s) for s, _ in texts], pa.int32()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(map(short, registers), pa.binary()), pa.array(second, pa.binary())], schema=schema)

    hashed = keyed_text(docs).withColumn("body", F.xxhash64("text"))
    return arrow_map(hashed, work, SKETCH)


def shingle_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, n, shingles, repeats) of the documents that ``rows`` (doc_id, body, node) names; shingles as ascending 64-bit numbers."""
    schema = arrow_schema(SHINGLES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [distinct((t or "").encode().split()) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part["node"], pa.array([len(s) for s, _ in sets], pa.int32()),
                    pa.array([s.tobytes() for s, _ in sets], pa.binary()),
                    pa.array([repeats(times) for _, times in sets], pa.binary())], schema=schema)

    named = rows.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "node")
    hashed = keyed_text(docs).withColumn("body", F.xxhash64("text"))
    found = hashed.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")))
    return arrow_map(found.select("node", "text"), work, SHINGLES).dropDuplicates(["node"])


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of ``own`` (ascending) each of ``others`` has; none of them is empty."""
    flat = np.concatenate(others)
    place = np.searchsorted(own, flat)
    place[place == len(own)] = 0
    return np.add.reduceat(own[place] == flat, np.cumsum([0] + [len(o) for o in others[:-1]]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are 0.8 or more alike in one of the two measures, as a written table."""
    schema = arrow_schema(PAIRS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = []
                for x, y, x_times, y_times in zip(*(part[c].to_pylist() for c in ("of_a", "of_b", "times_a", "times_b"))):
                    own, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    close = 9 * int(shared(own, [other])[0]) >= 4 * (len(own) + len(other))
                    if not close and (x_times is not None or y_times is not None):
                        close = alike(own, weights(len(own), x_times), other, weights(len(other), y_times))
                    keep.append(close)
                yield pa.RecordBatch.from_arrays([part["a"], part["b"]], schema=schema).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"), F.col("repeats").alias("times_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"), F.col("repeats").alias("times_b"))
    return save_round(arrow_map(pairs.join(left, "a").join(right, "b"), work, PAIRS), "near-links")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different nodes, the lesser first, whose sizes allow a similarity of 0.8.

    Sizes say nothing of the probability Jaccard of uneven texts.
    """
    fits = F.col("uneven_a") | F.col("uneven_b") | (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    return pairs.where(fits & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(buckets: DataFrame) -> DataFrame:
    """Links between components: pairs (a, b) of one bucket that are 0.8 or more alike in one of the two measures.

    ``buckets``: (bucket, band, node, component, n, registers, uneven, shingles, repeats). A bucket is cut into blocks by
    hash; each pair of blocks is one piece of at most about twice BLOCK rows, compared as arrays where it
    arrives. A pair that meets in several bands is compared in the first, pairs with an uneven text in each.
    """
    sizes = buckets.groupBy("bucket").agg((F.floor((F.count("*") - 1) / BLOCK) + 1).cast("int").alias("_cuts"))
    cut = buckets.join(sizes, "bucket").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_cuts")).cast("int"))
    keys, schema = ["bucket", "_i", "_j"], arrow_schema(PAIRS)
    dealt = cut.withColumn("_other", F.explode(F.expr("sequence(0, _cuts - 1)"))).select(
        "bucket", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        "_own", "band", "node", "component", "n", "registers", "uneven", "shingles", "repeats")

    def compare(rows: list[dict]) -> list[dict]:
        marks, real = (np.frombuffer(b"".join(marked), "<u4").reshape(len(rows), REGISTERS) for marked in (
            [r["registers"] for r in rows], [r["uneven"] or r["registers"] for r in rows]))
        uneven = np.array([r["uneven"] is not None for r in rows])
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        sizes, own = np.array([r["n"] for r in rows]), np.array([r["_own"] for r in rows])
        names: dict[bytes, int] = {}
        of = np.array([names.setdefault(r["component"], len(names)) for r in rows])
        band, within, out = rows[0]["band"], rows[0]["_i"] == rows[0]["_j"], []
        for x in range(len(rows) - 1):
            near = np.arange(x + 1, len(rows))
            near = near[(of[near] != of[x]) & (within | (own[near] != own[x]))]
            near = near[uneven[near] | uneven[x] | (
                5 * np.minimum(sizes[near], sizes[x]) >= 4 * np.maximum(sizes[near], sizes[x]))]
            if not len(near):
                continue
            same = marks[near] == marks[x]
            before = same[:, :band * ROWS].reshape(len(near), band, ROWS).all(2).any(1)
            apart = uneven[near] | uneven[x]
            agree = same.sum(1)
            agree[apart] = np.maximum(agree[apart], (real[near[apart]] == real[x]).sum(1))
            near = near[(agree >= LEAST_AGREEMENT * REGISTERS) & (apart | ~before)]
            if not len(near):
                continue
            both = shared(sets[x], [sets[y] for y in near])
            close = 9 * both >= 4 * (sizes[x] + sizes[near])
            for y, by_sets in zip(near, close):
                if of[y] != of[x] and (by_sets or (uneven[x] or uneven[y]) and alike(
                        sets[x], weights(sizes[x], rows[x]["repeats"]), sets[y], weights(sizes[y], rows[y]["repeats"]))):
                    out.append({"a": rows[x]["node"], "b": rows[y]["node"]})
                    of[of == of[y]] = of[x]
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    if (now := tuple(row[k] for k in keys)) != key:
                        if len(rows) > 1:
                            yield pa.RecordBatch.from_pylist(compare(rows), schema=schema)
                        key, rows = now, []
                    rows.append(row)
        if len(rows) > 1:
            yield pa.RecordBatch.from_pylist(compare(rows), schema=schema)

    return save_round(arrow_map(dealt.repartition(*keys).sortWithinPartitions(*keys), work, PAIRS), "across-links")


def labelled(nodes: DataFrame, components: DataFrame | None) -> DataFrame:
    """``nodes`` with the ``component`` of each node: itself where it has no link."""
    if components is None:
        return nodes.withColumn("component", F.col("node"))
    known = components.select("node", F.col("component").alias("_known"))
    return nodes.join(known, "node", "left").withColumn("component", F.coalesce("_known", "node")).drop("_known")


def components_of(links: DataFrame) -> DataFrame | None:
    return connected_components(links, "a", "b") if links.limit(1).count() else None


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, body, component) of every row: rows with the same component are one class.

    NULL and empty texts and texts of white space have no words and are one class. A text of fewer than five
    words is one shingle. NULL doc_id is a value; equal rows are in one class; extra columns are ignored; an
    empty table gives no rows. The result is a written table.
    """
    sketched = save_round(sketch_documents(docs), "sketches")
    texts = save_round(sketched.groupBy("node").agg(
        F.min(F.struct("doc_id", "body")).alias("of"), F.any_value("n").alias("n"),
        F.any_value("bands").alias("bands"), F.any_value("registers").alias("registers"),
        F.any_value("uneven").alias("uneven")).select(
        "node", "of.doc_id", "of.body", "n", "bands", "registers", "uneven"), "distinct-texts")
    spread = texts.select("node", "n", F.col("uneven").isNotNull().alias("uneven"), F.posexplode("bands").alias(
        "band", "bucket")).where("bucket is not null").withColumn("band", F.col("band") % BANDS)
    text = F.struct("node", "n", "uneven")
    crowded = spread.groupBy("bucket").agg(F.min(text).alias("least"), F.max(text).alias("greatest")).where(
        "least.node != greatest.node")
    members = save_round(spread.join(crowded, "bucket"), "buckets")
    named = texts.join(members.select("node").distinct(), "node").select("doc_id", "body", "node")
    sets = save_round(shingle_sets(docs, named), "shingle-sets")
    ends = members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("uneven").alias("uneven_a"), F.explode(
        F.array("least", "greatest")).alias("end")).select(
        "a", "n_a", "uneven_a", F.col("end.node").alias("b"), F.col("end.n").alias("n_b"), F.col("end.uneven").alias("uneven_b"))
    links = verified(ordered_pairs(ends), sets)
    components = components_of(links)
    # What is left: texts of one bucket that no path of links joins yet.
    held = labelled(members.select("bucket", "band", "node"), components)
    split = held.groupBy("bucket").agg(F.min("component").alias("_from"), F.max("component").alias("_to")).where(
        "_from != _to").select("bucket")
    open_ = held.join(split, "bucket").join(texts.select("node", "registers", "uneven"), "node").join(sets, "node")
    found = across(open_)
    if found.limit(1).count():
        components = components_of(links.union(found))
    classes = save_round(labelled(sketched.select("doc_id", "body", "node"), components), "near-classes")
    for done in (members, sets, links, found, texts, sketched):
        drop_round(done)
    return classes


def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each component of ``rows``, with ``class_rows``.

    Classes of more than a thousandth of all rows are known by broadcast (there are fewer than a thousand), so
    that no task gets a whole large class; the others are joined by shuffle.
    """
    facts = save_round(facts, "class-facts")
    least = (facts.agg(F.sum("class_rows")).first()[0] or 0) // HOT_SHARE
    hot, other = facts.where(F.col("class_rows") > least), facts.where(F.col("class_rows") <= least)
    marked = rows.join(F.broadcast(hot), "component", "left")
    rest = marked.where("class_rows is null").select(*rows.columns).join(other, "component")
    return marked.where("class_rows is not null").unionByName(rest)


def class_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_rows) of every row; class_id is the least doc_id of its class."""
    classes = duplicate_classes(docs)
    facts = classes.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return with_facts(classes, facts).select("doc_id", "class_id", "class_rows")


def first_of_class(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, that of the least (doc_id, text hash), NULL ids last, with the columns of ``docs``.

    Only the rows that go, and those that come several times, are looked up; others pass without a shuffle
    where these are few.
    """
    classes = duplicate_classes(docs)
    place = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "body")
    stays = classes.groupBy("component").agg(F.min(place).alias("stay"), F.count("*").alias("class_rows"))
    rows = with_facts(classes.groupBy("component", "doc_id", "body").agg(F.count("*").alias("times")), stays)
    chosen = place.eqNullSafe(F.col("stay"))
    rows = save_round(rows.select(F.col("doc_id").alias("_gone"), F.col("body").alias("_text"),
                                  chosen.alias("_stays"), "times").where("not _stays or times > 1"), "near-losers")
    held = packed(docs, F.col("doc_id").cast("bigint").alias("_id"),
                  F.xxhash64(F.col("text").cast("string")).alias("_body"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_body") == F.col("_text"))
    plain = held.join(rows, same, "left_anti")
    repeated = held.join(rows.where("_stays"), same, "left_semi").dropDuplicates(["_id", "_body"])
    return plain.union(repeated).select("row.*")
