"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

A text becomes a row of tokens (runs of letters, or numbers). Its template has
typed placeholders in place of slots: numbers, units right after a number, and
names (a capitalised word that follows a word of its sentence); all other words
stay, in lower case. A slot's value stands behind its placeholder's mark.
Every window of `window` template tokens of every document is hashed where the
document is read and meets the benchmark's windows in a hash join. A window with fewer than
`min_literals` words that are no slots would meet much by chance with its slots
open, so it is hashed with its slots' values and found verbatim only, in a pass of
its own that is made if the benchmark has such windows.

Matches of one document and item lie on diagonals (document position less item
position). On a diagonal each slot value of the item must map to one value of the
document (two may map to the same one): then the passage is the item, with other
parameters or the same. A diagonal whose slots contradict each other counts only its windows without slots
and those found verbatim. A document is contaminated by an item if the item's
windows found that way are at least `coverage` of the item's windows, or those of
them with open slots are at least `coverage` of the item's windows with open slots.

Items of the same tokens, slots' values included, are looked up once, under the least item_id.
Items of one template with other values are looked up each by itself: which of their values are equal
decides which parameters they can have, and their windows to be found verbatim differ.
Benchmark windows are broadcast while they are at most `block_rows` rows; a larger
benchmark meets the documents' windows in one shuffled join, which needs no second
look at the documents and splits hot windows. Its hashes alone are broadcast up to
`filter_rows` of them, so that only documents' windows that meet one are shuffled.
No row of a window carries its document's tokens out of generated code: the windows of a
document are buffered there together, which would take the square of its length.

Edge cases: null and empty texts have no windows and match nothing. Items with
fewer tokens than a window are looked up whole, by windows of their own length
(verbatim, if they have slots), down to `min_literals` tokens; shorter ones can't be told from chance and match
nothing. Repeated rows of one id and text count once.
Rows are told apart by doc_id and text, so of several rows of one id, or of none, only
those that hold an item are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomveil.llm import scratch

#: Units that form a slot after a number (fixed values).
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram "
         "kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
         "month months year years percent dollar dollars euro euros cent cents usd eur gbp degrees celsius fahrenheit kelvin joule joules watt watts volt volts pa hz")  # fmt: skip


@dataclass(frozen=True)
class LeakRules:
    window: int = 5
    min_literals: int = 3
    coverage: float = 0.3
    block_rows: int = 500_000
    filter_rows: int = 2_000_000


#: Marks before a slot's value; private-use characters, so no word has them.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"


def tokens(text: Column, names: bool = True) -> Column:
    """Words in lower case; numbers, names and units right after numbers as their mark and their value; without `names`, names have no mark.

    Whole-text replacements and one split: no step looks at single tokens.
    """
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    name = r"\p{Lu}(?<=[^.!?:\s]\s\p{Lu})\p{Ll}[\p{L}\p{M}]*"
    # up to four groups of digits, as in 1,234,567.89, and a unit; a unit's mark without a unit is removed below
    number = rf"([0-9]+)(?:[.,]([0-9]+))?(?:[.,]([0-9]+))?(?:[.,]([0-9]+))?(?:\s?((?i:{units}))(?![\p{{L}}\p{{M}}]))?"
    x = F.regexp_replace(F.regexp_replace(text, name, f" {NAME}$0 "), number, f" {NUMBER}$1$2$3$4 {UNIT}$5 ")
    cut = F.split(F.lower(x if names else F.translate(x, NAME, "")), rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NUMBER}{NAME}{UNIT}]+")
    return F.array_remove(F.array_remove(cut, F.lit("")), F.lit(UNIT))


def _canonical(token: Column) -> Column:
    mark = F.substring(token, 1, 1)
    return F.when(mark.between(NUMBER, UNIT), mark).otherwise(token)


def windows(df: DataFrame, keys: list[str], n: int, exact: bool = False) -> DataFrame:
    """keys, tokens, at and the hash of every window of n tokens: the template's, or with `exact` that of the tokens with their values."""
    # a capital makes a word a name or not by its place in the sentence, so that mark is no part of the verbatim text
    cut = df.select(*keys, tokens(F.col("text"), not exact).alias("tokens"))
    # The array stays with the row; hashes are computed window by window in generated code. A filter on the array,
    # such as plain explode() brings along, would be pushed down and compute the array twice.
    places = F.when(F.size("tokens") >= n, F.sequence(F.lit(0), F.size("tokens") - n))
    rows = cut.select(*keys, "tokens", F.explode_outer(places).alias("at")).where("at is not null")
    here = [F.get("tokens", F.col("at") + k) for k in range(n)]
    return rows.withColumn("hash", F.xxhash64(*(here if exact else map(_canonical, here))))


def _slots(n: int) -> Column:
    """A window's slot values in order, with their marks; by functions that stay in generated code, which array_compact() does not."""
    here = (F.get("tokens", F.col("at") + k) for k in range(n))
    return F.array_remove(F.array(*(F.when(F.substring(t, 1, 1).between(NUMBER, UNIT), t).otherwise(F.lit("")) for t in here)), F.lit(""))


def benchmark_windows(items: DataFrame, rules: LeakRules, n: int, whole: bool) -> DataFrame:
    """item_id, item_at, exact, hash, slots, windows and open_windows of the benchmark's windows; whole: of items of exactly n tokens only."""
    made = windows(items, ["item_id"], n)
    if whole:
        made = made.where(F.size("tokens") == n)
    here = [F.get("tokens", F.col("at") + k) for k in range(n)]
    literals = reduce(lambda a, b: a + b, ((~F.substring(t, 1, 1).between(NUMBER, UNIT)).cast("int") for t in here))
    made = made.withColumn("exact", literals < min(rules.min_literals, n))
    made = made.withColumn("hash", F.when(F.col("exact"), F.xxhash64(*(F.translate(t, NAME, "") for t in here))).otherwise(F.col("hash")))
    made = made.select("item_id", "at", "exact", "hash", _slots(n).alias("item_slots"), F.xxhash64("tokens").alias("same"))
    # an item's windows; those with open slots are held against their own number too
    sizes = made.groupBy("item_id").agg(F.count_distinct("at").alias("windows"), F.count_distinct(F.when(~F.col("exact"), F.col("at"))).alias("open_windows"))
    least = made.groupBy("same").agg(F.min("item_id").alias("item_id"))
    made = made.join(least, ["same", "item_id"], "left_semi").join(sizes, "item_id")
    return made.select("item_id", F.col("at").alias("item_at"), "exact", "hash", "item_slots", "windows", "open_windows").distinct()


def caught_rows(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """doc_id, text_hash, item_id, matched, windows and verbatim (no slot differs) of every row and item it contains."""
    docs = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    sizes = [r.n for r in items.select(F.size(tokens(F.col("text"))).alias("n")).where(f"n >= {rules.min_literals} and n < {rules.window}").distinct().collect()]
    parts = []
    for n in [*sizes, rules.window]:
        bench = scratch.table(benchmark_windows(items, rules, n, n < rules.window), "leak-windows")
        for exact in (False, True):
            some = bench.where(F.col("exact") == exact)
            held = some.count()
            if exact and not held:
                continue
            found = windows(docs, ["doc_id", "text_hash"], n, exact)
            if held <= rules.block_rows:
                some = F.broadcast(some)
            else:  # rows are shuffled: only those that meet a hash, and of them what the match needs
                hashes = some.select("hash").distinct()
                if hashes.count() <= rules.filter_rows:
                    found = found.join(F.broadcast(hashes), "hash", "left_semi")
                found = found.select("doc_id", "text_hash", "at", "hash", _slots(n).alias("slots"))
            slots = F.col("item_slots") if exact else _slots(n) if held <= rules.block_rows else F.col("slots")
            met = found.join(some, "hash")
            parts.append(met.select("doc_id", "text_hash", "item_id", "item_at", "exact", "windows", "open_windows", (F.col("at") - F.col("item_at")).alias("diagonal"), F.arrays_zip(F.col("item_slots").alias("a"), slots.alias("b")).alias("slots")))
    matches = reduce(DataFrame.unionByName, parts)
    # one group is a passage of one document: at most as many rows as the item has windows
    keys, is_open = ["doc_id", "text_hash", "item_id", "windows", "open_windows"], ~F.col("exact")
    lines = matches.groupBy(*keys, "diagonal").agg(
        F.collect_set("item_at").alias("all_at"),
        F.collect_set(F.when((F.size("slots") == 0) | F.col("exact"), F.col("item_at"))).alias("bare_at"),
        F.collect_set(F.when(is_open, F.col("item_at"))).alias("all_open"),
        F.collect_set(F.when(is_open & (F.size("slots") == 0), F.col("item_at"))).alias("bare_open"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"),
    )
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    lines = lines.withColumn("at", F.when(consistent, F.col("all_at")).otherwise(F.col("bare_at"))).withColumn("open_at", F.when(consistent, F.col("all_open")).otherwise(F.col("bare_open")))
    lines = lines.withColumn("same", F.forall("pairs", lambda p: p["a"] == p["b"]))
    n_of = lambda at: F.size(F.array_distinct(F.flatten(F.collect_list(at)))).cast("long")
    merged = lines.groupBy(*keys).agg(n_of("at").alias("matched"), n_of("open_at").alias("open_matched"), F.max_by("same", F.size("at")).alias("verbatim"))
    enough = lambda found, of: F.col(found) >= F.greatest(F.lit(1.0), F.col(of) * rules.coverage)
    return merged.where(enough("matched", "windows") | enough("open_matched", "open_windows")).select("doc_id", "text_hash", "item_id", "matched", "windows", "verbatim")


def contaminated(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """doc_id, item_id, matched, windows and verbatim of every document and item it contains, over the rows of each id."""
    caught = caught_rows(docs, items, rules)
    return caught.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"), F.max("verbatim").alias("verbatim"))


def drop_contaminated(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """`docs` without the rows that contain a benchmark item."""
    bad = caught_rows(docs, items, rules).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    bad = scratch.table(bad, "leak-rows")  # so that its size is known where it is joined
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("text") == F.col("__bad_hash")), "left_anti")
