"""Operator 4: benchmark decontamination, in DataFrame and SQL functions only.

Item-sized windows of the documents are laid where a shingle of an item occurs,
and a weighted share of common five-word shingles decides exactly: a window that
is to hold 80 % of an item's shingle weight must hold one of any shingles that
weigh more than 20 % of it, so the rarest such shingles of each item are looked
up and other windows cannot match. A window is compared with every item whose
shingle laid it. Equal windows of all documents are judged once.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinside.session import settle

SHINGLE, SIMILARITY = 5, 0.8
#: The looked-up shingles of a pass are a constant of its plan; a larger benchmark takes several passes.
PASS_SHINGLES = 50_000


def constant(values: list[int], kind: str) -> Column:
    """An array that the optimizer folds to a literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def held(value: Column) -> Column:
    """The value as a column of its own: what is not deterministic is not copied into the expressions that use it.

    A filter on a derived array would else be pushed below it, and the array
    computed again for each of its elements.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame) -> DataFrame:
    """Adds h1, the hashes of the words, and hashes, those of the shingles in order (none for fewer than five words)."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    at = ", ".join(f"h1[i + {k}]" for k in range(SHINGLE))
    return df.withColumn("hashes", held(F.expr(f"IF(size(h1) < {SHINGLE}, cast(array() AS array<bigint>), transform(sequence(0, size(h1) - {SHINGLE}), i -> xxhash64({at})))")))


def item_table(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, n, hashes, h1) of the items with five words or more."""
    named = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), words(F.col(text)).alias("words")).filter("item_id IS NOT NULL")
    items = with_shingles(named).filter(F.size("hashes") > 0)
    return settle(items.select("item_id", F.size("words").alias("n"), "hashes", "h1").distinct(), "items")


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, n, h, offset, weight, total, lead): the weight falls with the number of items that hold a shingle.

    ``lead`` marks the heaviest shingles of an item that together weigh more
    than the share which a match may lack.
    """
    each = items.select("item_id", "n", F.posexplode("hashes").alias("offset", "h")).groupBy("item_id", "n", "h").agg(F.min("offset").alias("offset"))
    held = each.groupBy("h").agg(F.count_distinct("item_id").alias("held"))
    count = items.agg(F.count_distinct("item_id").alias("items"))
    weighed = each.join(held, "h").withColumn("weight", 1 + F.ln(F.lit(count.first()["items"]) / F.col("held")))
    by_item = Window.partitionBy("item_id", "n")
    before = by_item.orderBy(F.desc("weight"), "h").rowsBetween(Window.unboundedPreceding, -1)
    summed = weighed.withColumn("total", F.sum("weight").over(by_item)).withColumn("ahead", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return settle(summed.withColumn("lead", F.col("ahead") <= (1 - SIMILARITY) * F.col("total") + 1e-9).drop("ahead"), "item_shingles")


def aligned_windows(docs: DataFrame, places: DataFrame, hashes: list[int], longest: int) -> DataFrame:
    """(doc_id, n, h, h1): the hashes of the words of each window of n words that puts a looked-up shingle h where its item has it.

    ``places`` has a row (h, offset, n) for each place. The look-up is a
    constant table of buckets; texts never leave their row, and of a hit only
    the words around it are kept.
    """
    m = 2 * max(1, len(hashes))
    ordered = sorted(hashes, key=lambda h: (h % m, h))
    ends = list(accumulate(Counter(h % m for h in hashes)[b] for b in range(m)))
    slots, start = constant(ordered, "bigint"), constant([0, *ends], "int")

    def known(h):
        b = F.pmod(h, F.lit(m)).cast("int")
        return F.array_contains(F.slice(slots, start[b] + 1, start[b + 1] - start[b]), h)

    hit = F.transform("hashes", lambda h, i: F.when(known(h), F.struct(i.alias("pos"), h.alias("h"))))
    rows = docs.withColumn("hits", held(F.array_compact(hit))).filter(F.size("hits") > 0).drop("hashes")
    around = f"transform(hits, x -> named_struct('pos', x.pos, 'h', x.h, 'first', greatest(0, x.pos - {longest}), 'near', slice(h1, greatest(0, x.pos - {longest}) + 1, {2 * longest + SHINGLE})))"
    found = rows.select("doc_id", F.explode(F.expr(around)).alias("x")).select("doc_id", "x.*").join(places, "h")
    start = F.greatest(F.lit(0), F.col("pos") - F.col("offset"))
    length = F.col("pos") - F.col("offset") + F.col("n") - start
    return found.select("doc_id", "n", "h", F.slice("near", start - F.col("first") + 1, length).alias("h1"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity) of each document that holds an item, or 80 % of its shingle weight in a window of its size.

    Null and empty texts hold nothing; items without an id or with fewer than
    five words match nothing; rows of one repeated doc_id count as one document
    and rows without an id are left out; repeated items of one id count once; an
    empty table on either side gives no rows.
    """
    items = item_table(benchmark, item_id, item_text)
    shingles = item_shingles(items)
    lead = shingles.filter("lead").select("h", "offset", "n").distinct()
    longest = items.agg(F.max("n")).first()[0]
    if longest is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, similarity double")
    hashes = [r["h"] for r in lead.select("h").distinct().sort("h").collect()]
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), words(F.col(text).cast("string")).alias("words")).filter("doc_id IS NOT NULL")
    rows = with_shingles(named).drop("words")
    found = None
    for at in range(0, len(hashes), PASS_SHINGLES):
        one = aligned_windows(rows, lead, hashes[at : at + PASS_SHINGLES], longest)
        found = one if found is None else found.unionByName(one)
    found = found.withColumn("window", F.xxhash64("h1")).groupBy("doc_id", "window").agg(F.first("h1").alias("h1"), F.collect_set(F.struct("n", "h")).alias("laid"))
    found = settle(found, "windows")
    windows = settle(found.groupBy("window").agg(F.first("h1").alias("h1")), "distinct_windows")
    laid = found.select("window", F.explode("laid").alias("x")).select("window", "x.*").distinct()
    matches = settle(matching(windows, laid, shingles), "matches")
    pairs = found.select("doc_id", "window").join(matches, "window")
    return pairs.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def matching(windows: DataFrame, laid: DataFrame, shingles: DataFrame) -> DataFrame:
    """(window, item_id, similarity) of the windows that hold an item; ``laid`` names the sizes and shingles that laid them."""
    near = laid.join(shingles.filter("lead").select("item_id", "n", "h"), ["n", "h"]).select("window", "item_id", "n").distinct()
    at = ", ".join(f"h1[i + {k}]" for k in range(SHINGLE))
    own = windows.select("window", F.explode(F.array_distinct(F.expr(f"IF(size(h1) < {SHINGLE}, cast(array() AS array<bigint>), transform(sequence(0, size(h1) - {SHINGLE}), i -> xxhash64({at})))"))).alias("h"))
    share = near.join(own, "window").join(shingles.select("item_id", "n", "h", "weight", "total"), ["item_id", "n", "h"])
    share = share.groupBy("window", "item_id", "n").agg((F.sum("weight") / F.first("total")).alias("similarity"))
    return share.filter(F.col("similarity") >= SIMILARITY - 1e-9).groupBy("window", "item_id").agg(F.max("similarity").alias("similarity"))


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, unchanged; rows without an id stay."""
    held = settle(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)
