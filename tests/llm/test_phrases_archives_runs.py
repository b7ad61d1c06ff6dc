"""Collocations, archives and periodic runs against brute force and the public ZIP and gzip readers."""

import gzip
import hashlib
import io
import json
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from zonehour.llm import collocations, periodic_runs, web_archives
from zonehour.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


# Collocations

def counted(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    return f, n


def brute_phrases(rows, least, inside, top):
    f, n = counted(rows)
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                covered[lang, w[i:i + size]] = max(covered[lang, w[i:i + size]], a)
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * covered[lang, w] >= inside * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        phrase = " ".join(w)
        found.setdefault(lang, []).append(
            ((-score, -a, phrase.encode()), (phrase, a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)))
    return sorted((lang, i + 1, *row) for lang, rows in found.items()
                  for i, (_, row) in enumerate(sorted(rows)[:top]))


def phrase_rows(df):
    assert [c for c, t in df.dtypes if t != "bigint"] == ["lang", "phrase"]
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made_texts(seed, docs, vocabulary):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(4)]
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.4 else
                         " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))))
        yield rng.choice(["en", "de", None]), rng.choice([" ", "  ", ". ", "\n", "\t", ";"]).join(parts)


@pytest.mark.parametrize("least, inside, top", [(2, 80, 10_000), (3, 50, 7), (1, 100, 10_000)])
def test_phrases_equal_brute_force(spark, least, inside, top):
    rows = list(made_texts(least, 60, ["a", "B", "c,", "d", "é", "zz", "1"])) + [
        ("en", None), ("en", ""), (None, None), ("und", "a b c d e"), ("de", " \t.;"), ("fr", "one"),
        ("en", "x y z " * 300), ("en", "x y z " * 300), ("es", "p q r s t u v w"), ("es", "p q r s t u v w")]
    df = spark.createDataFrame([(lang, text, i, "x") for i, (lang, text) in enumerate(rows)],
                               "lang string, text string, n int, gram string")
    assert phrase_rows(collocations.collocations(df, least, inside, top)) == brute_phrases(rows, least, inside, top)


def test_phrases_of_no_documents(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrase_rows(collocations.collocations(df)) == []


def test_paths_are_unary_and_spell_the_edges(spark):
    vocabulary = [f"w{i}" for i in range(40)]
    rows = list(made_texts(5, 80, vocabulary)) + [("de", " ".join(vocabulary))] * 3 + [("de", "r s t r s t r s t")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    counts = collocations.phrase_counts(df, 3)
    paths = collocations.compacted(counts)
    f, _ = counted(rows)
    want = {(lang, " ".join(w), n) for (lang, w), n in f.items() if len(w) == 4 and n >= 3}
    assert {tuple(r) for r in collocations.spelled(paths).collect()} == want
    assert collocations.spelled(paths).count() == len(want)
    found = paths.collect()
    assert ("de", " ".join(vocabulary), 3) in {tuple(r) for r in found} and any(r.path.count(" ") > 3 for r in found)
    for r in found:
        words = r.path.split()
        for i in range(1, len(words) - 3):  # the nodes inside a path have no other traffic
            assert f[r.lang, tuple(words[i:i + 3])] == r.n
        node = tuple(words[-3:])  # and no path could go on
        assert f[r.lang, node] != r.n or not [
            q for q in found if q.lang == r.lang and q.n == r.n and tuple(q.path.split()[:3]) == node]


def test_op11_on_the_documents(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert phrase_rows(QUERIES["op11_collocations"](spark, SF_DIR)) == brute_phrases(rows, 30, 80, 2000)


# Archives

ODD_PAGES = [
    (1, "http://a/", "x" * 1000), (2, "http://b/?q=1 2%20", "x" * 1000), (7, None, "x" * 1000), (3, "http://c/", "é" * 500),
    (4, "http://d/", "é" * 500), (5, "u", "y" * 999), (6, "u", "y" * 999), (8, "u", None), (9, "u", ""), (None, "u", "x" * 1000),
    (None, "v", "z" * 2000), (None, "v", "z" * 2000), (10, "line\r\nbreak", "WARC/1.1\r\n\r\nbody" * 200), (11, "r", "q" * 3000),
    (11, "r", "q" * 3000), (12, "long", "0123456789" * 300_000)]


def page_rows(pages):
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, other in pages if (other or "") == (html or "") and p is not None]
        keeper = max(same, default=None) if len(payload) >= 1000 and sum(
            (other or "") == (html or "") for _, _, other in pages) > 1 else page_id
        refers = None if keeper is None or keeper == page_id else keeper
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string").withColumns(
        {"digest": F.lit(1), "keeper": F.lit("k"), "size": F.lit(0)})


def test_archived_pages_equal_brute_force(spark, odd_pages, tmp_path):
    got = web_archives.archived_pages(odd_pages, f"file://{tmp_path}/a")
    assert sorted((tuple(r) for r in got.collect()), key=str) == page_rows(ODD_PAGES)
    assert web_archives.archived_pages(odd_pages.where("false"), f"file://{tmp_path}/b").count() == 0


def test_payloads_and_urls_come_back(spark, odd_pages, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = web_archives.write_archives(odd_pages, folder)
    places = web_archives.locate_records(manifest, folder)
    rows = web_archives.read_records(places, folder, 10 << 20).collect()
    assert sorted((r.page_id, r.url) for r in rows if r.page_id) == sorted((p, u) for p, u, _ in ODD_PAGES if p)
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None


def test_archives_are_plain_zip_and_gzip(spark, odd_pages, tmp_path):
    web_archives.write_archives(odd_pages.repartition(2), f"{tmp_path}/a").collect()
    seen = 0
    for path in sorted((tmp_path / "a").glob("*.wacz")):
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            data = z.read(web_archives.DATA)
            seen += gzip.decompress(data).count(b"WARC-Type: ") if data else 0
            for line in z.read(web_archives.INDEX).splitlines():
                entry = json.loads(line[line.index(b"{"):])
                assert gzip.decompress(data[entry["offset"]:entry["offset"] + entry["length"]]).startswith(b"WARC/1.1\r\n")
    assert seen == len(ODD_PAGES)


def test_op12_on_the_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op12_web_archives"](spark, SF_DIR).collect()), key=str) == page_rows(pages)


class Buffer:
    def __init__(self, data):
        self.data, self.reads = data, []

    def size(self):
        return len(self.data)

    def read_at(self, length, offset):
        self.reads.append(length)
        return self.data[offset:offset + length]


def warc_zip(records, index=True, prefix=b"", comment=b"", compression=zipfile.ZIP_STORED, zip64=False):
    out = io.BytesIO()
    packed = [gzip.compress(r, mtime=0) for r in records]
    with zipfile.ZipFile(out, "w", compression) as z:
        z.comment = comment
        with z.open("archive/data.warc.gz", "w", force_zip64=zip64) as member:
            member.write(b"".join(packed))
        if index:
            at, lines = 0, []
            for p in packed:
                lines.append("com,a)/ 2024 " + json.dumps({"filename": "data.warc.gz", "offset": str(at), "length": str(len(p))}))
                at += len(p)
            z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(["!meta {}", *lines]).encode()))
        z.writestr("pages/pages.jsonl", "{}")
    return prefix + out.getvalue()


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("prefix, comment, zip64", [(b"", b"", False), (b"#!stub\n", b"a comment PK\x05\x06 inside", False), (b"", b"", True)])
def test_records_of_foreign_archives(index, prefix, comment, zip64):
    records = [web_archives.record_bytes(i, f"u{i}", b"p" * i * 700_000, None) for i in range(4)]
    archive = web_archives.ZipDirectory(Buffer(warc_zip(records, index, prefix, comment, zip64=zip64)))
    places = list(web_archives.record_places(archive))
    assert [web_archives.parsed_record(zlib.decompress(archive.source.read_at(n, at), 31))["payload_bytes"]
            for at, n in places] == [i * 700_000 for i in range(4)]


def test_zip64_directory():
    """Sizes, offset and counts moved to ZIP64 records, as in archives over 4 GB."""
    plain = warc_zip([web_archives.record_bytes(1, "u", b"payload", None)], index=False)
    directory = web_archives.ZipDirectory(Buffer(plain))
    end = plain.rindex(b"PK\x05\x06")
    _, _, _, count, length, start, _ = struct.unpack_from("<HHHHIIH", plain, end + 4)
    central, entries, at = plain[start:start + length], b"", 0
    for _ in range(count):
        fixed = list(struct.unpack_from("<IHHHHHHIIIHHHHHII", central, at))
        n, m, k = fixed[10:13]
        wide = struct.pack("<HHQQQ", 1, 24, fixed[9], fixed[8], fixed[16])
        rest = central[at + 46:at + 46 + n] + b"\x99\x00\x02\x00xx" + wide
        fixed[8], fixed[9], fixed[16], fixed[11], fixed[12] = 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 6 + len(wide), 0
        entries += struct.pack("<IHHHHHHIIIHHHHHII", *fixed) + rest
        at += 46 + n + m + k
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(entries), start)
    locator = struct.pack("<IIQI", 0x07064B50, 0, start + len(entries), 1)
    last = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    wide = web_archives.ZipDirectory(Buffer(plain[:start] + entries + end64 + locator + last))
    assert wide.members == directory.members
    assert list(web_archives.record_places(wide)) == list(web_archives.record_places(directory))


def test_damaged_archives_are_errors():
    record = web_archives.record_bytes(1, "u", b"payload", None)
    good = warc_zip([record])
    for bad in (b"", b"not a zip file at all", good[:-30]):
        with pytest.raises(ValueError):
            list(web_archives.record_places(web_archives.ZipDirectory(Buffer(bad))))
    with pytest.raises(ValueError, match="compressed"):
        list(web_archives.record_places(web_archives.ZipDirectory(Buffer(warc_zip([record], compression=zipfile.ZIP_DEFLATED)))))
    with pytest.raises(ValueError, match="digest"):
        web_archives.parsed_record(record.replace(b"payload", b"PAYLOAD", 1) if b"payload\r\n" not in record
                                   else record.replace(b"payload\r\n", b"PAYLOAD\r\n"))


def test_only_asked_ranges_are_read():
    records = [web_archives.record_bytes(i, "u", random.Random(i).randbytes(50_000), None) for i in range(40)]
    source = Buffer(warc_zip(records))
    places = list(web_archives.record_places(web_archives.ZipDirectory(source)))
    assert sum(source.reads) < 100_000 < len(source.data)
    asked = [("a", *p) for p in places[3:6]] + [("a", *places[9]), ("b", *places[10])]
    ranges = list(web_archives._ranges(asked))
    assert [(p, len(e)) for p, _, e in ranges] == [("a", 3), ("a", 1), ("b", 1)]


# Periodic runs

def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(
                    all(w[i + t] == w[i + t + d] for t in range(length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


def test_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words, k = [], rng.choice([1, 2, 3, 8])
            for _ in range(rng.randint(0, 6)):
                part = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
                words += (part * rng.randint(1, 7))[:rng.randint(1, 80)]
            texts.append(words)
        assert periodic_runs.find_runs(texts) == [brute_runs(w) for w in texts]


def test_range_successor():
    rng = random.Random(2)
    for n in (1, 2, 7, 64, 100):
        values = periodic_runs.np.array(rng.sample(range(n), n))
        tree = periodic_runs.RangeSuccessor(values)
        for _ in range(50):
            lo = rng.randrange(n)
            hi = rng.randint(lo + 1, n)
            value = rng.choice(values[lo:hi].tolist())
            inside = values[lo:hi].tolist()
            got = tree.neighbours(*(periodic_runs.np.array([x]) for x in (lo, hi, value)))
            assert [int(g[0]) for g in got] == [min((x for x in inside if x > value), default=-1),
                                                max((x for x in inside if x < value), default=-1)]


def expected_digests(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_run_digests_of_odd_rows(spark):
    rows = [(None, None), (None, "a a a a a a"), (1, ""), (2, " \n\t"), (3, "a " * 5), (3, "a " * 6), (3, "a " * 6), (4, "x\x1cy\x85z　" * 9)]
    rows += [(i, ("ab c " * 30 + f"{i} ") * 5) for i in range(100, 160)] + [(9, "word " * 100_000)]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, period int, start string")
    got = sorted(map(tuple, periodic_runs.run_digests(df).collect()), key=str)
    want = [expected_digests(d, t) for d, t in rows[:-1]]
    assert [r for r in got if r[0] != 9] == sorted(want, key=str)
    assert [r[1:6] for r in got if r[0] == 9] == [(1, 0, 100_000, 1, 100_000_000)]
    assert periodic_runs.run_digests(df.where("false")).count() == 0


def test_run_rows_keep_text_and_runs(spark):
    df = spark.createDataFrame([(1, "so so so so so so it is"), (2, None), (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.run_rows(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 6, 1)] and got[1].collapsed == "so it is"
    assert got[2].runs == [] and got[2].collapsed == "" and got[None].collapsed == "a b"


def test_op13_on_the_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for row in got:
        if len((docs[row.doc_id] or "").split()) < 600:
            assert tuple(row) == expected_digests(row.doc_id, docs[row.doc_id])
