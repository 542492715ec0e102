"""Secret scans with an incremental blob ledger.

Every historical version of a document is content-addressed by the SHA-256 of
its text.  The ledger is a set of append-only Parquet tables in a shared folder:

* ``paths``: (doc_id, blob), which document held which blob;
* ``scans``: (blob, rules, found), one row for each blob and scan, where rules
  lists the ``name@version`` pairs that were run.

A scan takes the distinct blobs, drops the blob and rule-version pairs that the
ledger has, runs the rest, appends, and joins the findings back to every path.
All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, scratch_path, text_of


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost, non-overlapping; a match is dropped if group `group` is shorter than `least`."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: A key's span runs to its END line, or else over the base64 lines that follow.
PEM_HEAD = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"

#: Fixed patterns, in the order in which equal starts are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
    Rule("pem", 2, PEM_HEAD + r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/]{16,}={0,2})+(?:\s+[A-Za-z0-9+/]{1,15}={0,2})?|)", 0, 1, False),
    Rule("forge", 1, r"\bgh[pousr]_[A-Za-z0-9]{36}", 0, 1, False),
)

#: Runs of a class can be sought with the least length in the pattern: shorter runs match nothing else.  Possessive
#: groups match the same and don't recurse on long texts.
SOUGHT = {
    ("access", 1): r"AKIA[A-Z0-9]{16,}+",
    ("hex", 1): r"[0-9a-f]{24,}+",
    ("pem", 2): PEM_HEAD + r"(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:\s++[A-Za-z0-9+/]{16,}+={0,2}+)++(?:\s+[A-Za-z0-9+/]{1,15}={0,2})?|)",
}

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in text: array of (start, rank, end, kind), code points, end exclusive.

    Splitting at the pattern gives the gaps between the matches, so a running
    sum of lengths gives every position.
    """
    pattern = F.lit(SOUGHT.get((rule.name, rule.version), rule.pattern))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, SOUGHT.get((rule.name, rule.version), rule.pattern))
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["hit"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.name).alias("kind")).cast(SPAN)
        size = F.char_length(F.regexp_extract(pair["hit"], rule.pattern, rule.group)) if rule.group else F.char_length(pair["hit"])
        return F.struct(end.alias("at"), F.when(size >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


class Ledger:
    """The ledger's tables below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.paths, self.scans = spark, f"{folder}/paths", f"{folder}/scans"

    def seen(self) -> DataFrame | None:
        """blob, seen: the rule versions run on it; None before the first scan."""
        if not exists(self.spark, self.scans):
            return None
        return self.findings().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))

    def findings(self) -> DataFrame:
        return self.spark.read.schema(f"blob string, rules array<string>, found array<{SPAN}>").parquet(self.scans)

    def known_paths(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, blob string").parquet(self.paths)

    def append(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Record versions (doc_id, text) and scan the blob and rule-version pairs that are new.

        Copies meet once per blob: the distinct step is combined before its
        shuffle.  A blob with all rule versions in the ledger isn't scanned.
        """
        addressed = versions.select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("blob"), text_of().alias("text"))
        seen = self.seen()
        blobs = addressed.select("blob", "text").dropDuplicates(["blob"])
        due = F.array(*[F.lit(r.key) for r in rules])
        if seen is None:
            blobs = blobs.withColumn("due", due)
        else:
            blobs = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(due, F.coalesce("seen", F.array().cast("array<string>"))))
            blobs = blobs.filter(F.size("due") > 0)
        none = F.array().cast(f"array<{SPAN}>")
        each = [
            F.when(F.array_contains("due", r.key), spans_of(F.col("text"), r, k)).otherwise(none) if seen is not None else spans_of(F.col("text"), r, k)
            for k, r in enumerate(rules)
        ]
        scanned = blobs.select("blob", F.col("due").alias("rules"), F.array_sort(F.concat(*each)).alias("found"))
        scanned.write.mode("append").parquet(self.scans)
        addressed.select("doc_id", "blob").write.mode("append").parquet(self.paths)

    def by_blob(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, found: the spans of these rule versions in blobs that have any, in order."""
        wanted = [r.key for r in rules]
        version = {r.name: r.key for r in rules}
        of = F.create_map(*[F.lit(x) for pair in version.items() for x in pair])
        hits = self.findings().filter(F.size("found") > 0)
        spans = hits.select("blob", F.explode(F.filter("found", lambda s: F.array_contains(F.col("rules"), of[s["kind"]]))).alias("s"))
        spans = spans.filter(F.col("s.kind").isin([r.name for r in rules]))
        assert len(wanted) == len(version), "one version of each rule at a time"
        return spans.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("found"))


def report(spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and found of every path that the ledger in folder has, of whatever scan; a pair of both is one path."""
    ledger = Ledger(spark, folder)
    held = ledger.known_paths().distinct()
    return held.join(ledger.by_blob(rules), "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def scan(docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found, the spans of each row of docs, through a ledger in folder.

    One row comes back for each row of docs, repeated ones too; a null or empty
    text has no spans; an empty table gives no rows.  Only doc_id and text are
    read, so other columns can't clash.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, folder or scratch_path(spark, "secret-ledger"))
    ledger.append(docs.select("doc_id", "text"), rules)
    held = docs.select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("blob")) if folder else ledger.known_paths()
    return held.join(ledger.by_blob(rules), "blob", "left").select(
        "doc_id", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found")
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of the rules replaced by ``[kind]`` in text, by plain DataFrame functions.

    Spans come from the ledger per blob; each row takes its own text's findings.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, scratch_path(spark, "secret-ledger"))
    ledger.append(docs.select("doc_id", "text"), rules)
    columns = docs.columns
    blob = F.sha2(text_of().cast("binary"), 256)
    rows = docs.select(*[F.col(c).alias(f"d_{k}") for k, c in enumerate(columns)], blob.alias("blob"), F.col("text").alias("text"))
    clean = {c: F.col(f"d_{k}").alias(c) for k, c in enumerate(columns)}
    found = ledger.by_blob(rules)
    done = rows.join(found, "blob", "left")

    def step(state: Column, s: Column) -> Column:
        fresh = s["end"] > state["at"]
        begin = F.greatest(s["start"], state["at"])
        gap = F.substring(F.col("text"), state["at"] + 1, begin - state["at"])
        mark = F.when(s["start"] >= state["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.when(fresh, s["end"]).otherwise(state["at"]).alias("at"), F.when(fresh, F.concat(state["out"], mark)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("found", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.char_length("text"))))
    clean["text"] = F.when(F.col("found").isNull(), F.col("text")).otherwise(whole).alias("text")
    return done.select(*[clean[c] for c in columns])


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document; base columns are of the kinds assign, access and hex."""
    found = scan(documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["kind"].isin([r.name for r in RULES if r.base]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
