"""The pipeline's stages against brute force, on whole small tables."""

import re
import shutil
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import documents_of
from tests.llm.test_documents import base_by_brute_force, components_by_brute_force, secrets_by_brute_force
from tidelog.llm import bpe, decontam


def staged(spark, place, k):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:k]:
        docs = stage(spark, docs, place)
    return docs


@pytest.fixture(params=["odd", "small", "empty"])
def folder(request, tmp_path, empty):
    place = request.getfixturevalue(request.param)
    if request.param == "odd":
        shutil.copytree(f"{place}/documents.parquet", f"{tmp_path}/documents.parquet")
        shutil.copytree(f"{empty}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)
    return place


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def lines_by_brute_force(docs):
    """For each (doc_id, text, host) the text without lines that are too frequent on its host, or None if it is rejected."""
    plain = lambda x: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    texts, held = {}, {}
    for _, t, host in docs:
        texts.setdefault(host, set()).add(t or "")
    for host, own in texts.items():
        n = Counter(x for t in own for x in {plain(line) for line in t.split("\n")} - {""})
        held[host] = {x for x, k in n.items() if k >= 5 and k > 0.05 * len(own)}
    out = []
    for i, t, host in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if plain(x) not in held[host]]
        clean, b = "\n".join(left), base_by_brute_force(t)
        bad = b[0] < 10 or 100 * b[4] > 20 * b[0] or len(left) < len(lines) and (count(clean) < 10 or count(clean) < 0.2 * b[0])
        out.append((i, None if bad else clean, len(lines) - len(left)))
    return out


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = staged(spark, folder, 1)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    want = lines_by_brute_force(documents_of(spark, folder))
    assert Counter(documents_of_frame(got)) == Counter((i, t) for i, t, _ in want if t is not None)


def test_quality_on_small_and_hot_hosts(spark):
    """Hosts of six documents and one with most of all rows lose their lines; a line of a few documents stays."""
    words = lambda k: " ".join("".join(chr(97 + int(c)) for c in f"{k}{j}") + "q" * j for j in range(12))
    menu, rare = "Home | About | Contact us today", "seen now and then"
    data = [(k, f"{menu}\n{words(k)}", f"small{k % 4}") for k in range(24)]
    data += [(100 + k, (f"{menu}\n" if k % 11 == 0 else "") + (f"{rare}\n" if k % 50 == 0 else "") + words(100 + k), "hot") for k in range(900)]
    data += [(2000, f"{menu}\nfew words", "hot"), (2001, None, "hot"), (2002, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = lines_by_brute_force(data)
    assert sum(1 for *_, n in want if n) == 24 + 82 + 1 and not any(t is not None and menu in t for _, t, _ in want)
    got = corpus_pipeline.quality_rules(spark, docs, None)
    assert Counter(documents_of_frame(got)) == Counter((i, t) for i, t, _ in want if t is not None)


def test_dedup_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.near_dedup(spark, docs, folder)
    assert got.columns == docs.columns
    kept = documents_of_frame(got)
    of = documents_of(spark, folder)
    want = components_by_brute_force(of)
    assert Counter(i for i, *_ in kept if i is not None) == Counter({c for *_, c in want if c is not None})
    # of the rows without an id one is linked to nothing; the empty one is linked to others with ids
    assert sum(1 for i, _ in kept if i is None) == sum(1 for *_, c in want if c is None)


def documents_of_frame(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_decontamination_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    gone = {r["doc_id"] for r in decontam.leaks(docs.filter("doc_id is not null").select("doc_id", "text"), items).collect()}
    got = corpus_pipeline.decontaminate(spark, docs, folder)
    assert got.columns == docs.columns
    assert rows(got) == Counter(tuple(r) for r in docs.collect() if r["doc_id"] not in gone)


def test_secret_stage(spark, folder):
    got = corpus_pipeline.scan_secrets(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    want = Counter()
    for i, t, _ in documents_of(spark, folder):
        if t is not None:
            out, at = "", 0
            for a, _, b, kind in secrets_by_brute_force(t):
                if b > at:
                    if a >= at:
                        out += t[at:a] + f"[{kind}]"
                    at = b
            t = out + t[at:]
        want[i, t] += 1
    assert Counter(documents_of_frame(got)) == want


def test_whole_run(spark, small, empty):
    got = corpus_pipeline.run(spark, small)
    before = staged(spark, small, 4).select("doc_id", "text")
    own = bpe.codec(bpe.default_path())
    want = {r["doc_id"]: own.encode(r["text"]) for r in before.collect()}
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == want and len(want) > 50
    assert got.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_dedup_stage_reaches_similarity(spark, empty):
    """Edited copies at five-word similarity 0.8 or more meet in one document; less similar ones stay."""
    import random

    from tidelog.llm import jaccard

    rnd = random.Random(9)
    data = []
    for k in range(40):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        data.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            other = list(words)
            for _ in range(2 * j + 1):
                other[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
            data.append((10 * k + j, " ".join(other)))
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in data}
    parent = {i: i for i, _ in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    close = [(a, b) for a in parent for b in parent if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in close:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, empty).collect()}
    assert len(close) > 40
    assert not [(a, b) for a, b in close if a in kept and b in kept]
    apart = {r["doc_id"] for r in corpus_pipeline.similar_dedup(spark, docs, empty).collect()}
    assert apart == {i for i in parent if root(i) == i}


@pytest.mark.parametrize("long_band", [2, 2048])
def test_similarity_within_bands(spark, long_band):
    """Many texts in one band that aren't all linked: no link is lost, by whole bands and by pairs a few numbers apart at a time."""
    import random

    from tidelog.llm import jaccard

    rnd = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):
        other = list(base)
        for _ in range(rnd.randrange(1, 9)):
            other[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        texts.append((k, " ".join(other)))
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in texts}
    keys = {i: set(jaccard.bands(t)) for i, t in texts}
    parent = {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and keys[a] & keys[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {i: root(i) for i in parent if sum(root(j) == root(i) for j in parent) > 1}
    got = jaccard.labels(spark.createDataFrame(texts, "t long, text string"), reach=3, long_band=long_band)
    assert {r["node"]: r["label"] for r in got.collect()} == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_distinct_texts(spark, limit, monkeypatch):
    """Each text once, nulls as empty ones; texts that are distinct already aren't shuffled or written again."""
    written, stored, sized = [], corpus_pipeline.stored, corpus_pipeline.sized
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: written.append(name) or stored(df, name))
    monkeypatch.setattr(corpus_pipeline, "sized", lambda df, row_bytes: sized(df, row_bytes, limit))
    data = [(k, f"text {k % 7}" if k < 20 else f"other {k}") for k in range(30)] + [(30, None), (31, ""), (None, "text 1")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.distinct_texts(docs).collect()]
    assert sorted(t for _, t in got) == sorted({t or "" for _, t in data}) and len({h for h, _ in got}) == len(got)
    assert written == ["repeated-texts", "texts"]
    written.clear()
    alone = corpus_pipeline.distinct_texts(docs.filter("doc_id between 20 and 30"))
    assert sorted(r["text"] for r in alone.collect()) == sorted(t or "" for i, t in data if i and 20 <= i <= 30)
    assert written == ["repeated-texts"] and "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_workers_keep_no_other_tables():
    """The encoder's tables, of the pipeline's last stage, don't wait beside an executor while other stages work."""
    import weakref

    import pyarrow as pa

    from tidelog.llm import jaccard, quality

    texts = pa.array(["one two three one two three", None])
    for work in (quality.measure_batches, jaccard.band_batches, jaccard.shingle_batches):
        own = weakref.ref(bpe.codec(bpe.default_path()))
        got = list(work(iter([texts.fill_null("")])))
        assert len(got[0]) == 2 and own() is None
    again = bpe.codec(bpe.default_path())
    assert again is bpe.codec(bpe.default_path()) and again.decode(again.encode("one two")) == "one</w> two</w>"
