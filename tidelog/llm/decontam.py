"""Benchmark decontamination by template canonicalisation.

Text becomes tokens; numbers, names and units become typed placeholders and the
other words are lower-cased.  Windows of the resulting template are hashed and
joined with those of the benchmark, so a question that was asked again with
other numbers or names still meets its original.  Windows with enough fixed
words are sought; where one of an item's meets a document, all of the item's
windows are compared on that diagonal, and the values in the slots are checked:
each value of the item must have been replaced by one value throughout.  A
capitalised word that isn't marked as a name, as at the start of a sentence, is
a fixed word when windows are sought; where it differs from one on the other
side, both count as names.  Items without windows that could be sought are
sought by their literal tokens.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import broadcast_if_small, documents, stored, text_of

#: Template words in a window, and those of them that must be fixed words.
WINDOW = 6
LEAST_FIXED = 3
#: Items in which no window has this many fixed words, or that are shorter than a window, are sought by literal tokens ...
LEAST_TEMPLATE = 2
#: ... if they have this many tokens or bytes of tokens.
LITERAL_TOKENS, LITERAL_BYTES = 3, 20
#: A document holds an item when it has this share of the item's windows with consistent slots.
LEAST_SHARE = 0.5

#: Units that stand for themselves, in lower case.
UNITS = (
    "%", "$", "€", "£", "°", "mm", "cm", "km", "kg", "mg", "lb", "lbs", "oz", "ml", "mph", "kmh", "ghz", "mhz", "hz", "kw", "kwh", "mb", "gb", "tb",
    "percent", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "inch", "inches", "feet", "yards", "gram", "grams",
    "kilogram", "kilograms", "pound", "pounds", "liter", "liters", "litre", "litres", "dollar", "dollars", "euro", "euros", "cents",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "degrees",
)

#: Marks a name: a capitalised word, not all capitals, after a lower-case word or a comma, so not at the start of a sentence.
MARK = "\ue001"
NAME = r"(?<=[\p{Ll},;:] )(\p{Lu}[\p{Ll}\p{M}]+)(?!\p{L})"
CAPITALISED = r"^\p{Lu}[\p{Ll}\p{M}]+$"
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\x{E001}?[\p{L}\p{M}]+|[%$€£°]"


def tokens_of(text: Column) -> Column:
    """Tokens as they are written; names begin with MARK, numbers with a digit."""
    clean = F.translate(text, MARK, " ")
    return F.regexp_extract_all(F.regexp_replace(clean, NAME, MARK + "$1"), F.lit(TOKEN), F.lit(0))


def slot_type(token: Column) -> Column:
    """number, name or unit for a slot's token, null for a fixed word."""
    return F.when(token.between("0", ":"), "number").when(token.startswith(MARK), "name").when(F.lower(token).isin(*UNITS), "unit")


def may_be_name(token: Column) -> Column:
    """Marked as a name, or capitalised."""
    return token.startswith(MARK) | (token.rlike(CAPITALISED) & ~F.lower(token).isin(*UNITS))


def template(tokens: Column, loose: bool = False) -> Column:
    """The hash of each token, or of its type where it is a slot's; a fixed word's is odd, a slot's is even.

    loose: capitalised words are names.
    """

    def word(t: Column) -> Column:
        kind = slot_type(t)
        return F.when(kind.isNull(), F.xxhash64(t).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(kind).bitwiseAND(F.lit(-2)))

    marked = F.transform(tokens, lambda t: F.when(may_be_name(t) & ~t.startswith(MARK), F.concat(F.lit(MARK), t)).otherwise(t)) if loose else tokens
    return F.transform(F.transform(marked, F.lower), word)


def literal(tokens: Column) -> Column:
    """The hash of each token's value."""
    return F.transform(tokens, lambda t: F.xxhash64(F.translate(F.lower(t), MARK, "")))


def windows(words: str, size: int = WINDOW) -> Column:
    """The hash of every window of a template, given as a column's name: it is read once a window."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(every)


def with_windows(table: DataFrame, key: str, loose: bool = False) -> DataFrame:
    """key, copy (the text's hash: rows may share a key), tokens, words (the template) and w (its windows) of table (key, text).

    w is to be exploded with posexplode_outer: posexplode would have the planner
    put a filter on w below these columns, and so compute them for each window.
    """
    tokens = table.select(key, F.xxhash64(text_of()).alias("copy"), tokens_of(text_of()).alias("tokens"))
    return tokens.withColumn("words", template(F.col("tokens"), loose)).withColumn("w", windows("words"))


def sought_windows(items: DataFrame, loose: bool = False) -> DataFrame:
    """item_id, item (its tokens), w, window, item_at, bare of each window of items (item_id, text) that is sought.

    These have LEAST_FIXED fixed words or more; in items without such windows,
    as many as the best has, LEAST_TEMPLATE at least.  bare: no word of it may
    be a name that isn't marked as one.
    """
    every = with_windows(items, "item_id", loose).select("item_id", "tokens", "words", "w", F.posexplode_outer("w").alias("item_at", "window"))
    part = lambda c: F.slice(c, F.col("item_at") + 1, F.lit(WINDOW))
    fixed = every.filter("window is not null").withColumn("fixed", F.size(F.filter(part("words"), lambda x: x.bitwiseAND(F.lit(1)) == 1)))
    fixed = fixed.withColumn("bare", ~F.exists(part("tokens"), lambda t: may_be_name(t) & ~t.startswith(MARK)))
    best = fixed.groupBy(F.col("item_id").alias("of"), F.col("tokens").alias("of_tokens")).agg(F.least(F.max("fixed"), F.lit(LEAST_FIXED)).alias("least"))
    kept = fixed.join(best, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("tokens") == F.col("of_tokens"))).filter((F.col("fixed") >= F.col("least")) & (F.col("fixed") >= LEAST_TEMPLATE))
    return kept.select("item_id", F.col("tokens").alias("item"), "w", "window", "item_at", "bare")


def on_diagonal(item: Column, doc: Column, w: Column, wide: bool) -> Column:
    """array of one struct(found, slots): the item's windows that doc, as many tokens from the same place on, has, and their slots' values.

    wide: all windows are compared, and two words that may be names are equal; else those with LEAST_FIXED fixed words.
    """
    plain = lambda t: F.translate(F.lower(t), MARK, "")

    def slot(i: Column, d: Column) -> Column:
        same = slot_type(i).eqNullSafe(slot_type(d)) & (slot_type(i).isNotNull() | (plain(i) == plain(d)))
        if wide:
            same = same | (may_be_name(i) & may_be_name(d))
        fixed = slot_type(i).isNull() & ((plain(i) == plain(d)) if wide else F.lit(True))
        return F.struct(F.coalesce(d.isNotNull() & same, F.lit(False)).alias("same"), F.coalesce(fixed, F.lit(False)).alias("fixed"), plain(i).alias("i"), plain(d).alias("d"))

    def compared(state: Column) -> Column:
        parts = F.transform(w, lambda x, k: F.struct(x.alias("x"), F.slice(state, k + 1, F.lit(WINDOW)).alias("part")))
        held = F.filter(parts, lambda x: F.forall(x["part"], lambda s: s["same"]) & (F.lit(wide) | (F.size(F.filter(x["part"], lambda s: s["fixed"])) >= LEAST_FIXED)))
        pairs = F.flatten(F.transform(held, lambda x: F.transform(F.filter(x["part"], lambda s: ~s["fixed"]), lambda s: F.struct(s["i"].alias("i"), s["d"].alias("d")))))
        return F.struct(F.transform(held, lambda x: x["x"]).alias("found"), F.array_distinct(pairs).alias("slots"))

    # within an array, so that the tokens are compared once and not for each window
    return F.transform(F.array(F.zip_with(item, doc, slot)), compared)


def met_by_template(docs: DataFrame, sought: DataFrame, loose: bool = False) -> DataFrame:
    """doc_id, copy, item_id, n_windows, diagonal, item, w and part, the document's tokens where the item's would be."""
    every = with_windows(docs, "doc_id", loose).select("doc_id", "copy", "tokens", F.posexplode_outer("w").alias("doc_at", "window"))
    side = broadcast_if_small(sought, F.lit(60) + 2 * F.octet_length(F.array_join("item", "")) + 40 * F.size("item"))
    diagonal = F.col("doc_at") - F.col("item_at")
    part = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.get(F.col("tokens"), F.col("doc_at") - F.col("item_at") + j))
    return every.join(side, "window").select("doc_id", "copy", "item_id", F.size(F.array_distinct("w")).alias("n_windows"), diagonal.alias("diagonal"), "item", "w", part.alias("part"))


def met_by_literals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, copy, item_id, asked, matched, n_windows, changed of items (item_id, tokens) by windows of literal tokens, shorter ones where the item is."""
    own = stored(items.withColumn("asked", F.xxhash64("tokens")).withColumn("words", literal(F.col("tokens"))).withColumn("size", F.least(F.size("tokens"), F.lit(WINDOW))), "literal-items")
    every = None
    for size in sorted(r["size"] for r in own.select("size").distinct().collect()):  # WINDOW values at most
        sought = own.filter(F.col("size") == size).withColumn("w", F.array_distinct(windows("words", size))).select("item_id", "asked", F.size("w").alias("n_windows"), F.explode("w").alias("window"))
        held = docs.select("doc_id", F.xxhash64(text_of()).alias("copy"), literal(tokens_of(text_of())).alias("words")).select("doc_id", "copy", F.explode_outer(F.array_distinct(windows("words", size))).alias("window"))
        met = held.join(broadcast_if_small(stored(sought, "literal-windows"), F.lit(40)), "window").distinct()
        every = met if every is None else every.unionByName(met)
    return every.groupBy("doc_id", "copy", "item_id", "asked", "n_windows").agg(F.count(F.lit(1)).alias("matched")).withColumn("changed", F.lit(0))


def leaks(docs: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row (doc_id, item_id, matched_windows, item_windows, changed_slots) for each item that a document holds.

    docs has doc_id and text, items item_id and text; other columns aren't read.
    Null and empty texts hold nothing.  Each row is compared by itself, whatever
    its doc_id; of rows that share one (a null one, too), and of items that share
    an item_id, the pair with the greatest share is reported.  Items with equal
    texts are all reported; an empty table gives no rows.  The
    items' windows are broadcast if their measured size allows it; beyond that
    the windows meet by a shuffle on their hash.  Items whose every sought window
    has a capitalised word are sought a second time with those as names.
    """
    sought = stored(sought_windows(items), "benchmark-windows")
    met = met_by_template(docs, sought.drop("bare"))
    bare = sought.filter("bare").select("item_id").distinct()
    capital = items.join(bare.withColumnRenamed("item_id", "of"), F.col("item_id").eqNullSafe(F.col("of")), "left_anti")
    loose = stored(sought_windows(capital, True).drop("bare"), "capital-windows")
    if loose.take(1):
        # an item's windows are counted by the first template
        first = with_windows(capital, "item_id").select(F.col("item_id").alias("of"), F.col("tokens").alias("of_tokens"), F.col("w").alias("first_w"))
        loose = loose.join(first, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("item") == F.col("of_tokens"))).select("item_id", "item", F.col("first_w").alias("w"), "window", "item_at")
        met = met.unionByName(met_by_template(docs, stored(loose.distinct(), "capital-windows"), True))
    # an item has boundedly many windows and slots, so these sets are bounded
    pair = ("doc_id", "copy", "item_id", "asked", "n_windows")
    parts = met.withColumn("asked", F.xxhash64("item")).groupBy(*pair, "diagonal", "item", "w").agg(F.collect_set(F.struct("part")).alias("parts"))
    both = F.array(*[F.flatten(F.transform("parts", lambda p: on_diagonal(F.col("item"), p["part"], F.col("w"), wide))) for wide in (False, True)])  # noqa: B023
    seen = parts.select(*pair, F.posexplode(both).alias("rank", "seen"))
    one = seen.select(*pair, "rank", F.flatten("seen.found").alias("found"), F.array_distinct(F.flatten("seen.slots")).alias("slots"))
    values = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    consistent = one.filter(F.size("slots") == values)
    changed = F.size(F.filter("slots", lambda s: s["i"] != s["d"]))
    whole = consistent.withColumn("changed", changed).groupBy(*pair, "rank")
    total = whole.agg(F.size(F.array_distinct(F.flatten(F.collect_set("found")))).alias("matched"), F.max("changed").alias("changed"))
    # a pair that holds by the sought windows alone is reported with these
    enough = total.filter(F.col("matched") >= least_share * F.col("n_windows"))
    total = enough.groupBy(*pair).agg(F.min_by(F.struct("matched", "changed"), "rank").alias("t")).select(*pair, "t.matched", "t.changed")
    template_items = stored(sought.select("item_id").unionByName(loose.select("item_id")).distinct(), "template-items")
    rest = items.join(template_items.withColumnRenamed("item_id", "of"), F.col("item_id").eqNullSafe(F.col("of")), "left_anti").select("item_id", tokens_of(text_of()).alias("tokens"))
    rest = stored(rest.filter((F.size("tokens") >= LITERAL_TOKENS) | (F.octet_length(F.array_join("tokens", "")) >= LITERAL_BYTES)), "literal-items")
    if rest.take(1):
        total = total.unionByName(met_by_literals(docs, rest))
    held = total.filter(F.col("matched") >= least_share * F.col("n_windows"))
    number = lambda c: F.col(c).cast("long").alias(c)
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("n_windows")).alias("share"), number("matched"), number("n_windows"), number("changed"))).alias("t"))
    return best.select("doc_id", "item_id", F.col("t.matched").alias("matched_windows"), F.col("t.n_windows").alias("item_windows"), F.col("t.changed").alias("changed_slots"))


def op8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(documents(spark, sf_dir).select("doc_id", "text"), items.select("item_id", "text"))
