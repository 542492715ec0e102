"""ORC tokens, ZIP WARC archives and decontamination against brute force."""

import hashlib
import os
import struct
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCUMENTS, PAGES, documents_of
from tidelog.llm import bpe, decontam, orc_tokens, zipwarc


@pytest.fixture(params=["odd", "small", "empty"])
def folder(request):
    return request.getfixturevalue(request.param)


def test_orc_round_trip(spark, folder):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_path())
    got = orc_tokens.op5_orc_tokens(spark, folder).collect()
    at, want = 0, Counter()
    ids_of = {}
    for i, t, _ in documents_of(spark, folder):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        ids_of.setdefault(i, []).append(ids)
        want[i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


def test_orc_metadata_pruning(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = orc_tokens.write(docs.repartition(3), f"file://{tmp_path}/orc")
    whole = {r["doc_id"]: (r["start"], r["ids"]) for r in orc_tokens.read(spark, path).collect()}
    some = orc_tokens.read(spark, path, [7, 100, 10**9])
    assert {r["doc_id"]: (r["start"], r["ids"]) for r in some.collect()} == {i: whole[i] for i in (7, 100)}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    import pyarrow.orc as orc

    part = next(p for p in (tmp_path / "orc").iterdir() if p.suffix == ".orc")
    assert orc.ORCFile(str(part)).row_index_stride == 1000


def test_orc_starts_with_several_files_a_partition(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: (r["start"], r["ids"]) for r in orc_tokens.read(spark, orc_tokens.write(docs, f"file://{tmp_path}/whole")).collect()}
    options = {"spark.sql.files.maxRecordsPerFile": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        path = orc_tokens.write(docs, f"file://{tmp_path}/split")
    finally:
        for k in options:
            spark.conf.unset(k)
    names = [p.name for p in (tmp_path / "split").glob("*.orc")]
    parts = Counter(n.split("-")[1] for n in names)
    assert len(parts) > 1 and max(parts.values()) > 1
    assert {r["doc_id"]: (r["start"], r["ids"]) for r in orc_tokens.read(spark, path).collect()} == want


def test_orc_skips_by_indexes_and_bloom_filters(spark, tmp_path):
    """A present id costs a row group, an absent one within the range of ids costs no row."""
    docs = spark.range(0, 12_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        path = orc_tokens.write(docs, f"file://{tmp_path}/orc")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def scanned(doc_id):
        found = spark.read.schema(orc_tokens.SCHEMA).orc(path).filter(F.col("doc_id") == doc_id)
        rows = found.collect()
        return len(rows), found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert scanned(5000)[0] == 1 and scanned(5000)[1] <= 1000
    assert [scanned(k) for k in (5001, 7003, 9005)].count((0, 0)) >= 2
    assert scanned(100_000) == (0, 0)


def test_archives_need_a_known_store():
    with pytest.raises(ValueError, match="nosuch://"):
        zipwarc.filesystem("nosuch://bucket/path")
    assert zipwarc.filesystem("file:/tmp/x")[1] == "/tmp/x"


def by_brute_force(rows):
    first = Counter()
    least = {}
    for i, _, h in rows:
        p = (h or "").encode()
        first[p] += 1
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        to = least.get(p) if len(p) >= 100 else None
        revisit = to is not None and (i is None or i > to)
        want[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    return want


ODD_PAGES = [
    (1, "http://a.example/x\r\nWARC-Type: evil", "é" * 60),
    (2, None, "é" * 60),
    (2, "http://a.example/100%25", "é" * 60),
    (None, "http://b.example/", "é" * 60),
    (3, "http://b.example/", None),
    (4, "http://b.example/", ""),
    (5, "http://b.example/", "x" * 99),
    (6, "http://b.example/", "x" * 99),
    (7, "http://b.example/", "\r\n\r\nWARC/1.1\r\n" + "y" * 200_000),
    (0, "http://b.example/", "\r\n\r\nWARC/1.1\r\n" + "y" * 200_000),
]


def test_warc_round_trip(spark, small, tmp_path):
    spark.createDataFrame(ODD_PAGES, PAGES).withColumn("first", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    for place in (str(tmp_path), small):
        rows = [tuple(r) for r in spark.read.parquet(f"{place}/pages.parquet").select("page_id", "url", "html").collect()]
        got = zipwarc.op9_zip_warc(spark, place).collect()
        assert Counter(tuple(r) for r in got) == by_brute_force(rows)


def test_warc_empty(spark, empty):
    assert zipwarc.op9_zip_warc(spark, empty).count() == 0


def test_warc_archives_are_zip_files(spark, tmp_path):
    table = spark.createDataFrame([(i, f"http://a.example/{i}", f"<p>{i}</p>" * 40) for i in range(50)], PAGES)
    manifest = zipwarc.write(table.coalesce(1), f"file://{tmp_path}/warc", archive_bytes=1500)
    names = [r["archive"] for r in manifest.collect()]
    assert len(names) > 1 and not [p for p in os.listdir(f"{tmp_path}/warc") if p.endswith(".part")]
    for name in names:
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and {i.filename for i in z.infolist()} == {zipwarc.DATA, zipwarc.INDEX}
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    urls = {r["url"] for r in zipwarc.read(manifest, f"file://{tmp_path}/warc").collect()}
    assert urls == {f"http://a.example/{i}" for i in range(50)}


def test_zip64_directory(tmp_path):
    """A central directory whose sizes and places stand in ZIP64 fields."""
    import pyarrow.fs as pafs

    body, name = b"hello range", b"archive/data.warc.gz"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(body), len(body), len(body), len(name), 0) + name + body
    extra = struct.pack("<HH3Q", 1, 24, len(body), len(body), 7)
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = 7 + len(local)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path = tmp_path / "wide.zip"
    path.write_bytes(b"padding" + local + entry + end64 + locator + end)
    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        place, n = zipwarc.directory(f, f.size())[name.decode()]
        f.seek(place)
        assert f.read(n) == body


ITEMS = [
    (1, "A train leaves the green station at 9 with 120 people and meets old Maria after 45 km, then Maria counts 120 people again."),
    (2, "Wholly different words about the slow growth of certain mosses under granite ledges in winter months of the north."),
    (3, "too short"),
    (4, None),
]


def test_leaks(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    other = "A train leaves the green station at 11 with 77 people and meets old Pedro after 60 miles, then Pedro counts 77 people again."
    broken = "A train leaves the green station at 11 with 77 people and meets old Pedro after 60 miles, then Ahmed counts 78 people again."
    pad = "some clean sentence goes on and on without any of it being asked. " * 5
    data = [
        (10, pad + ITEMS[0][1] + " " + pad, "en", "a", 1),
        (11, pad + other, "en", "a", 1),
        (12, pad + broken, "en", "a", 1),
        (13, pad + ITEMS[1][1].lower() + " more", "en", "a", 1),
        (20, pad + ITEMS[1][1].upper().replace(" ", "\n"), "en", "a", 1),
        (14, pad, "en", "a", 1),
        (15, None, None, None, None),
        (16, "", None, None, None),
        (17, "too short", None, None, None),
        (18, "A train leaves the green station today and that is all there is to it.", None, None, None),
        (19, (pad * 50 + ITEMS[1][1]) * 3, None, None, None),
        (19, (pad * 50 + ITEMS[1][1]) * 3, None, None, None),
        (None, ITEMS[1][1], None, None, None),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(spark.createDataFrame(data, DOCUMENTS), items).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (19, 2), (20, 2), (None, 2)}
    assert got[10, 1]["changed_slots"] == 0 and got[11, 1]["changed_slots"] >= 4
    assert decontam.op8_templates(spark, empty).count() == 0


def test_leaks_equal_brute_force(spark, medium):
    """Whole items in whole documents, found by comparing runs of words."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()}
    want = set()
    for i, t, _ in documents_of(spark, medium):
        run = " " + " ".join(words(t)) + " "
        want |= {(i, k) for k, w in items.items() if f" {' '.join(w)} " in run}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op8_templates(spark, medium).collect()}
    assert got == want and want


def held(spark, asked, docs):
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame, items).collect()}


def test_leaks_of_items_with_many_slots(spark):
    """Number-dense and short items, copied verbatim and asked again."""
    asked = [
        "A car drives 60 km in 2 hours, 90 km in 3 hours and 150 km in 5 hours.",
        "Compute 12 + 7 - 3 + 45 - 6. Then add 8 + 9 - 14 + 2.",
        "What is 17 * 23 + 4?",
        "小明有五个苹果，他吃了两个，还剩几个？",
        "3 + 4 + 5 + 6 + 7 + 8 = ?",
    ]
    pad = "some clean sentence goes on and on. "
    docs = [pad + x + " " + pad for x in asked]
    docs += ["A car drives 70 km in 4 hours, 80 km in 6 hours and 160 km in 7 hours.", "Compute 13 + 8 - 4 + 46 - 7. Then add 5 + 10 - 15 + 3."]
    docs += ["A car drives 60 km in the rain.", "Compute 1 or 2. What is 18 * 24 + 5?", "1 2 3 4 5 6 then 9 9 9 9"]
    assert held(spark, asked, docs) == {(k, k) for k in range(5)} | {(5, 0), (6, 1)}


def test_leaks_with_names_that_begin_sentences(spark):
    asked = [
        "Tom has 5 apples. Ann has 3 apples. Bob has 7 apples. How many apples are there in all?",
        "Tom has 5 apples. Ann has 3. Who has more?",
        "The old mill by the river was built long ago. Then Tom sold it.",
    ]
    docs = [
        "Sam has 6 apples. Eve has 2 apples. Max has 9 apples. How many apples are there in all?",
        "Read this.\nSam has 6 apples.\nEve has 2. Who has more?",
        '"Sam has 6 apples. Sam buys 2. Who is it?"',
        "The old mill by the river was built long ago. Then Tom sold it.",
        "sam has 6 pears and eve has 2 of them, who has more?",
    ]
    assert held(spark, asked, docs) == {(0, 0), (1, 1), (3, 2)}


def test_leaks_of_rows_that_share_an_id(spark, tmp_path):
    """Two variants under one doc_id, and two under a null one, are found like each alone; the SQL agrees."""
    import duckdb

    from tidelog.llm.oracle import ORACLE_SQL

    ask = "A train leaves the green station at {} with {} people and meets old {} after {} km, then {} counts {} people again."
    variant = lambda *v: ask.format(v[0], v[1], v[2], v[3], v[2], v[1])
    rows = [(1, variant(11, 77, "Pedro", 60)), (1, variant(8, 31, "Anna", 14)), (None, variant(7, 12, "Ivan", 9)), (None, variant(5, 99, "Olga", 3)), (2, variant(4, 5, "Nina", 6)), (2, None), (3, "clean words")]
    items = [(1, variant(9, 120, "Maria", 45)), (1, "Wholly different words about the slow growth of certain mosses under granite ledges."), (2, variant(9, 120, "Maria", 45))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("asked", F.lit("clash")).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in decontam.op8_templates(spark, str(tmp_path)).collect())
    assert {(i, k) for i, k, *_ in got} == {(i, k) for i in (1, None, 2) for k in (1, 2)}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert Counter(con.sql(ORACLE_SQL["op8_templates"]).fetchall()) == got
