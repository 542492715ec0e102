"""A training corpus from the documents table, in five stages.

Each stage is a function (spark, docs, sf_dir) that works on all documents the
one before it kept; its result is written as Parquet and read again.  All but
the last return the columns they were given, whatever their names and number.

In every stage a null text counts as an empty one, texts are read whole, rows
with a null doc_id are rows like others, and an empty table gives an empty one.
Rows are told apart by all their columns: rows that are equal in all of them are
one row repeated, which the near-duplicate stage alone thins out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontam, jaccard, quality, secrets, simhash
from tidelog.llm.common import broadcast_if_small, documents, scratch_path, sized, stored, text_of


def row_key(docs: DataFrame) -> Column:
    """A key for rows that differ in any column, nulls included."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    parts = [x for c in docs.columns for x in (F.char_length(part(c)).cast("string"), F.lit("|"), part(c))]
    return F.md5(F.concat(*parts).cast("binary"))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs with whole rows in one column, row_, so that no column's name can clash with an operator's."""
    return docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "text", *more)


def unpacked(df: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The rows again, with another text where one is given; n_chars follows a changed text."""
    out = {c: F.col("row_")[c] for c in docs.columns}
    if text is not None:
        if "n_chars" in out:
            changed = ~text.eqNullSafe(out["text"])
            out["n_chars"] = F.when(changed, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
        out["text"] = text
    return df.select(*[x.alias(c) for c, x in out.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; furniture lines go from those that stay.

    A null or empty text has too few words, so its row goes.  A null source is a
    source like others.  Repeated rows all stay, or all go.
    """
    judged = quality.judge(packed(docs, F.col("source")))
    return unpacked(judged.filter("kept"), docs, F.col("clean_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the least doc_id stays, once.

    Of several rows with this doc_id the one with the least key stays; a null
    doc_id comes after all others.  Texts without words are linked.
    """
    rows = packed(docs, row_key(docs).alias("key_"))
    linked = simhash.link(rows.select("doc_id", "text", "key_"), carry=("key_",))
    first = linked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")).alias("first"))
    stay = stored(first.select("first.key_"), "first-of-group")
    once = rows.select("row_", "key_").dropDuplicates(["key_"])  # equal rows are combined before the shuffle
    return unpacked(once.join(stay, "key_", "left_semi"), docs)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """t, a hash, and text, once for each text of docs, a written table.

    Texts are read where they are if none repeats; else only those that repeat are shuffled, as long as their hashes
    can be broadcast.
    """
    each = docs.select(F.xxhash64(text_of()).alias("t"), text_of().alias("text"))
    repeated = stored(each.groupBy("t").count().filter("count > 1").select("t"), "repeated-texts")
    if not repeated.take(1):
        return each
    some, small = sized(repeated, F.lit(8))
    if not small:
        return stored(each.dropDuplicates(["t"]), "texts")
    return stored(each.join(some, "t", "left_anti").unionByName(each.join(some, "t", "left_semi").dropDuplicates(["t"])), "texts")


def similar_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked by five-word similarity of 0.8 or more the document with the least doc_id stays.

    Ties are as in near_dedup; of equal texts one row stays.  Texts without words
    are linked by being equal only.
    """
    text = F.xxhash64(text_of())
    labels = jaccard.labels(distinct_texts(docs)).select(F.col("node").alias("t_"), F.col("label").alias("group_"))
    rows = packed(docs, row_key(docs).alias("key_"), text.alias("t_"))
    linked = stored(rows.select("doc_id", "key_", "t_").join(broadcast_if_small(stored(labels, "labels"), F.lit(16)), "t_"), "linked")
    first = linked.groupBy("group_").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_")).alias("first"))
    gone = stored(linked.join(first, "group_").filter("key_ <> first.key_").select("key_").distinct(), "similar")
    return unpacked(rows.join(broadcast_if_small(gone, F.octet_length("key_")), "key_", "left_anti"), docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies go: those by fingerprints, and of what stays those by five-word similarity.

    Fingerprints of 64 bits can't tell a similarity of 0.8, where 10 bits differ
    on average, so the second step is there for the ones in between.
    """
    return similar_dedup(spark, stored(near_dedup(spark, docs, sf_dir), "fingerprints-apart"), sf_dir)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Each row is judged by its own text, whatever its doc_id; items with a null or
    empty text are held by none.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = packed(docs, row_key(docs).alias("key_"))
    held = decontam.leaks(rows.select(F.col("key_").alias("doc_id"), "text"), items)
    gone = stored(held.select(F.col("doc_id").alias("key_")).distinct(), "contaminated")
    return unpacked(rows.join(broadcast_if_small(gone, F.octet_length("key_")), "key_", "left_anti"), docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; no row goes, a null text stays null.

    Overlapping spans become one mark, of the kind that begins first.
    """
    return unpacked(secrets.redact(packed(docs)), docs, F.col("text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the decoded text; a null or empty text has no ids."""
    done = bpe.tokenize(docs.select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", *bpe.digests())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", scan_secrets),
    ("BPE encoding and decoding", tokenize),
]

#: Fingerprints and encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{k}")
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
