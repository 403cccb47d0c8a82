"""Benchmark decontamination: short test items found inside long documents.

An item is found in a document that contains at least ``threshold`` of the
item's distinct shingles of five words (lower case, letters and digits only).

MinHash signatures of whole documents say nothing of an item a thousand times
shorter, so only the items are sketched, and documents are probed with all of
their shingles. Items are partitioned by size, in classes of doubling size; the
sketch of an item is its least hashes, as many as its class may miss plus one.
A document that reaches the threshold then holds at least one hash of the
sketch, whatever its length: no pair is lost. Candidates are verified by exact
containment of the shingles' texts.

All of it is DataFrame expressions. Documents are read twice; shuffled are the
candidates. Sketches, texts with candidates (by their keys) and texts with items
are broadcast while they are below a number of rows by count; beyond it each is
joined by shuffle.

Defined cases: null texts are empty; an item of fewer than five words is one
shingle of all its words; items without words are found nowhere; equal item ids
are told apart by their text and the better one counts for the id, likewise for
document ids; null ids are ids like others; no row on either side, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import col, cut, fresh

SHINGLE, THRESHOLD = 5, 0.8
#: Rows of a table (of short rows) up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _shingled(words: str, length: int, make) -> Column:
    """``make(first place)`` of each shingle of ``length`` words."""
    n = F.size(words)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), make)).otherwise(F.array())


def _hashes(words: str, length: int) -> Column:
    return _shingled(words, length, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(length)])).cast("array<bigint>")


def _texts(words: str, length: int) -> Column:
    return _shingled(words, length, lambda i: F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(length)])).cast("array<string>")


def _item_shingles(items: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(``item``, ``item_hash``, ``length``, ``n``, ``hash``, ``shingle_text``), a row per distinct shingle."""
    listed = items.select(col(id_column).alias("item"), F.xxhash64(F.coalesce(col(text_column), F.lit(""))).alias("item_hash"), words_of(col(text_column)).alias("words"))
    sized = listed.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(shingle)))
    either = None
    for length in range(1, shingle + 1):
        own = sized.where(F.col("length") == length).withColumn("shingle_text", F.explode(F.array_distinct(_texts("words", length))))
        hashed = own.withColumn("hash", F.xxhash64(*[F.get(F.split("shingle_text", " "), F.lit(k)) for k in range(length)]))
        part = hashed.select("item", "item_hash", "length", "hash", "shingle_text").distinct()
        either = part if either is None else either.unionByName(part)
    counts = either.groupBy(F.col("item").alias("of_item"), F.col("item_hash").alias("of_hash")).agg(F.count("*").alias("n"))
    same = F.col("item").eqNullSafe(F.col("of_item")) & (F.col("item_hash") == F.col("of_hash"))
    return cut(either.join(counts, same).select("item", "item_hash", "length", "n", "hash", "shingle_text"))


def _sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """The least hashes of each item, as many as its size class may miss plus one."""
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the class
    may_miss = largest - F.ceil(largest * F.lit(threshold) - F.lit(1e-9))
    ordered = shingles.groupBy("item", "item_hash", "length", "n").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    return ordered.select("item", "item_hash", "length", F.explode(F.slice("hashes", 1, (may_miss + 1).cast("int"))).alias("hash"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(``id``, ``text_hash``, ``item``, ``matched``, ``n``) for each distinct document text and item found in it."""
    shingles = _item_shingles(items, item_column, item_text, shingle)
    n_rows = shingles.count()
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect())  # five values at most
    sketches = _small(_sketches(shingles, threshold).select("hash", "length", F.col("item").alias("sketch_item"), F.col("item_hash").alias("sketch_hash")), n_rows)
    texts = docs.select(col(id_column).alias("id"), F.xxhash64(F.coalesce(col(text_column), F.lit(""))).alias("text_hash"), words_of(col(text_column)).alias("words"))

    def probe(length: int) -> DataFrame:
        return texts.select("id", "text_hash", F.explode(_hashes("words", length)).alias("probe")).join(sketches.where(F.col("length") == length), F.col("probe") == F.col("hash"))

    found = None
    for length in lengths:
        part = probe(length).select("id", "text_hash", "sketch_item", "sketch_hash")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.where(F.lit(False)).select("id", "text_hash", F.lit(None).cast(shingles.schema["item"].dataType).alias("sketch_item"), F.lit(0).cast("long").alias("sketch_hash"))
    per_text = cut(found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("sketch_item", "sketch_hash")).alias("candidates")))
    n_pairs = per_text.agg(F.sum(F.size("candidates"))).first()[0] or 0
    wanted = per_text.select(F.col("id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"), "candidates")
    same = F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))
    again = texts.join(_small(wanted, n_pairs), same).select("id", "text_hash", "words", "candidates")
    verified = None
    for length in lengths:
        own = _small(shingles.where(F.col("length") == length), n_rows)
        inside = again.select("id", "text_hash", "candidates", F.explode(F.array_distinct(_texts("words", length))).alias("text_shingle"))
        hit = inside.join(own, F.col("text_shingle") == F.col("shingle_text")).where(F.array_contains("candidates", F.struct(F.col("item").alias("sketch_item"), F.col("item_hash").alias("sketch_hash"))))
        part = hit.select("id", "text_hash", "item", "item_hash", "n", "text_shingle")
        verified = part if verified is None else verified.unionByName(part)
    if verified is None:
        return found.select("id", "text_hash", F.col("sketch_item").alias("item"), F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("n"))
    counted = verified.groupBy("id", "text_hash", "item", "item_hash", "n").agg(F.count_distinct("text_shingle").alias("matched"))
    return counted.where(F.col("matched") >= F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9))).select("id", "text_hash", "item", "matched", "n")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(``id``, ``item``, ``matched``, ``n``, ``containment``) for each document and item found in it."""
    best = matches(docs, items, **options).groupBy("id", "item").agg(F.max(F.struct(F.col("matched") / F.col("n"), "matched", "n")).alias("best"))
    return best.select("id", "item", F.col("best.matched"), F.col("best.n"), (F.col("best.matched") / F.col("best.n")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; all columns as they were."""
    row_hash, key, hashed = fresh(docs, "row_text_hash", "found_id", "found_hash")
    found = cut(matches(docs, items, id_column, text_column, **options).select(F.col("id").alias(key), F.col("text_hash").alias(hashed)).distinct())
    tagged = docs.withColumn(row_hash, F.xxhash64(F.coalesce(col(text_column), F.lit(""))))
    same = col(id_column).eqNullSafe(F.col(key)) & (F.col(row_hash) == F.col(hashed))
    return tagged.join(_small(found, found.count()), same, "left_anti").drop(row_hash)
