"""Quality rules: base text rules, and cross-document line frequency.

Lines are normalised and hashed.  For every host the distinct documents that
hold a line are counted (texts that are equal count once, so that copies of one
document don't make its lines look like furniture).  Lines in more than a share
of the host's documents are removed, and a document is rejected when too little
of it remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, join_side, lean, small_batches, stored, text_of

#: A line is furniture in more than this share of its host's distinct documents, and in this many at least.
LINE_SHARE = 0.05
LINE_DOCS = 5
#: A document that loses lines is rejected when it keeps fewer words, or a smaller share of its words.
LEAST_WORDS = 10
LEAST_SHARE = 0.20

WINDOW = 5
LEAST_DOC_WORDS = 10
MOST_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)

BASE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
WHITE = r"[\x20\x09-\x0D]"


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of `size` that occur twice or more, each word counted once."""
    n = len(words) - size + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(n)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i] = hit[j] = 1
    covered, reach = 0, 0
    for i in range(n):
        if hit[i]:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    chars = len(text) - (len(raw) - sum(map(len, words)))  # white space is one byte a code point
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, len(raw.translate(None, NOT_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


@lean
def measure_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [x.split(":")[0] for x in BASE[len("struct<") : -1].split(",")]
    for texts in batches:
        rows = [measures(t.as_py() or "") for t in texts]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def base_measures(text: Column) -> Column:
    """The measures; said to be nondeterministic so that no filter is moved below them and has them, and all before, made twice."""
    return F.arrow_udf(measure_batches, BASE).asNondeterministic()(text)


def line_hash(line: Column) -> Column:
    """Hash of a line: lower case, digits as 0, runs of white space as one space; 0 for a line without words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), f"{WHITE}+", " "), r"\d", "0"))
    return F.when(plain == "", F.lit(0).cast("long")).otherwise(F.xxhash64(plain))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def frequent_lines(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCS) -> DataFrame:
    """host and furniture, a map of the hashes of the lines above the limits, over all documents.

    A null host is a host of its own.  A line above the share is held by so many
    documents that a host has at most the lines of an average document times
    1 / share of them.
    """
    own = docs.select(F.col("source").alias("host"), F.xxhash64(text_of()).alias("content"), lines_of(text_of()).alias("lines"))
    hashed = own.select("host", "content", F.explode_outer(F.array_distinct(F.transform("lines", line_hash))).alias("line"))
    # hash 0, the line without words, isn't counted as a line; as every document is given it once, it counts documents
    every = own.select("host", "content", F.lit(0).cast("long").alias("line"))
    counted = (
        hashed.filter(F.col("line") != 0)
        .unionByName(every)
        .groupBy("host", "line", "content")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count("one").alias("docs"))
    )
    counted = stored(counted.filter((F.col("docs") >= least) | (F.col("line") == 0)), "line-counts")
    hosts = counted.filter("line = 0").select(F.col("host").alias("of"), F.col("docs").alias("all_docs"))
    above = counted.filter("line <> 0").join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("docs") > share * F.col("all_docs"))
    marked = F.transform(F.sort_array(F.collect_set("line")), lambda x: F.struct(x.alias("key"), F.lit(True).alias("value")))
    return above.groupBy("host").agg(F.map_from_entries(marked).alias("furniture"))


def words_in(text: Column) -> Column:
    """Words of a text, counted by the JVM."""
    trimmed = F.trim(F.regexp_replace(text, f"{WHITE}+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def judge(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCS) -> DataFrame:
    """docs with the base measures, base_failed, clean_text, n_removed_lines and kept.

    docs needs text and source.  Every row gets one row back, repeated rows too;
    a null text counts as empty (and so fails the base rules), with clean_text
    null.  clean_text is the text without furniture lines.  Own columns with
    added names are replaced.
    """
    small_batches(docs.sparkSession)
    furniture = stored(frequent_lines(docs, share, least), "furniture")
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_removed_lines", "kept", "host", "furniture", "base")
    docs = docs.drop(*added)
    joined = join_side(docs.withColumn("host", F.col("source")), furniture, ["host"], F.size("furniture") * 24, "left").drop("host")
    lines = lines_of(F.col("text"))
    kept_lines = F.filter(lines, lambda x: ~F.map_contains_key(F.col("furniture"), line_hash(x)))
    some = F.col("furniture").isNotNull() & F.col("text").isNotNull()
    out = (
        joined.withColumn("kept_lines", F.when(some, kept_lines))
        .withColumn("n_removed_lines", F.coalesce(F.size(lines) - F.when(F.col("kept_lines").isNotNull(), F.size("kept_lines")), F.lit(0)).cast("long"))
        .withColumn("clean_text", F.when(F.col("n_removed_lines") > 0, F.array_join("kept_lines", "\n")).otherwise(F.col("text")))
        .withColumn("left_words", F.when(F.col("n_removed_lines") > 0, words_in(F.col("clean_text"))))
        .withColumn("base", base_measures(text_of()))
    )
    failed = (F.col("base.n_words") < LEAST_DOC_WORDS) | (100 * F.col("base.n_repeat_words") > MOST_REPEAT_PERCENT * F.col("base.n_words"))
    out = out.withColumn("base_failed", failed)
    depleted = (F.col("left_words") < LEAST_WORDS) | (F.col("left_words") < LEAST_SHARE * F.col("base.n_words"))
    return out.select(
        *docs.columns,
        "base.*",
        "base_failed",
        "clean_text",
        "n_removed_lines",
        (~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False))).alias("kept"),
    )


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of every document."""
    judged = judge(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines")
