"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Wherever one of the commonest words of a language (an anchor) stands, the next
content words, that is words that are no anchors, form a chain; anchor and
chain are a signature, and the set of a text's signatures is its fingerprint.
Running prose is full of anchors, menus and tables are not, so the fingerprint
follows the prose. Likeness of two fingerprints is the Jaccard measure of
their sets.

``linked`` finds all pairs above a threshold. Sets are partitioned by their
length so that only sets of the same and the next partition can be alike.
Within partitions, sets meet over their rarest signatures, as many as a set may
miss plus one, and are compared unless their lengths alone rule it out. Equal
sets are one class; pairs are between classes.

``against_next`` holds each text against an edited form of itself and against
the text that follows by descending id. Texts go, once, to buckets of the
order, of which each also gets the first text of the next, so a task needs no
other bucket.

Words are runs of letters and digits of ASCII, in lower case, and of all
characters beyond it. A text without any chain has each word followed by the
next ones for signatures, or all its words if they are fewer.

Defined cases: a null text is empty; without words the set is empty, and two
empty sets are alike (1); null ids come last in descending order; rows of one
id follow by a hash of their text; equal rows follow each other, so the next of
all but the last is an equal one, and copies are counted before they are
shuffled; a single row is its own next; no row, no result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import col, cut, schema_of

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """a an and are as at be but by for from had has have he in is it not of on or that the this to was were which with you
    aber als am auf aus bei das dem den der des die ein eine einer er es für hat ich im ist mit nicht sich sie sind und von war wie zu zum zur
    au aux ce cette dans de des du elle en est et il je la le les mais ne nous ou où par pas pour qui que sa se ses son sont sur un une
    al como con del el era es esta este ha las lo los más no o para pero por se sin su sus una y""".split()
)
#: Content words of a chain, and how many content words further each is than the one before.
CHAIN, DISTANCE = 3, 1
THRESHOLD = 0.8
#: Bytes of text of a bucket of the order, and buckets at most, since every task knows where each begins; beyond, buckets grow.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 50_000
_ANCHORS = frozenset(w.encode() for w in ANCHORS)
#: Lower-case ASCII letters and digits stay, as do all bytes of other characters; the rest is blank.
_SPELLED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def signatures(text: str | None, anchors: frozenset[bytes] = _ANCHORS, chain: int = CHAIN, distance: int = DISTANCE) -> set[bytes]:
    """The signatures of a text."""
    words = (text or "").encode().translate(_SPELLED).split()
    content, spots = [], []
    for word in words:
        if word in anchors:
            spots.append((word, len(content)))
        else:
            content.append(word)
    last = len(content) - (chain - 1) * distance - 1
    first = distance - 1
    found = {b" ".join((word, *content[at + first : at + first + (chain - 1) * distance + 1 : distance])) for word, at in spots if at + first <= last}
    if not found and words:
        found = {b" ".join(words[i : i + chain + 1]) for i in range(max(1, len(words) - chain))}
    return found


def fingerprint(found: set[bytes]) -> str:
    """Digest of a set; equal if and only if the sets are."""
    return hashlib.sha256(b"\n".join(sorted(found))).hexdigest()


def likeness(a: set, b: set, least: float = 0.0) -> float:
    """Jaccard measure; 0 where the lengths alone keep it below ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(a & b)
    return both / (small + large - both)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of the other one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


# --------------------------------------------------------------------------- each text and the next


_KEYED = "bucket int, guest boolean, missing boolean, down long, hash long, copies long, id long, text string"
_COMPARED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, copies long"


def _dealt(cuts: list[tuple]):
    """Rows with their bucket, equal rows of a batch counted, and the first row of each bucket as guest of the one before."""
    place = {key: b for b, key in enumerate(cuts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("missing", "down", "hash"))))
            first: dict[tuple, int] = {}
            copies: dict[tuple, int] = {}
            for i, key in enumerate(keys):
                first.setdefault(key, i)
                copies[key] = copies.get(key, 0) + 1
            rows = [(i, bisect_right(cuts, key) - 1, False, copies[key]) for key, i in first.items()]
            rows += [(first[key], (place[key] - 1) % len(cuts), True, 1) for key in first.keys() & place.keys()]
            if rows:
                at, bucket, guest, counts = zip(*rows)
                picked = batch.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(guest), *(picked.column(c) for c in ("missing", "down", "hash")), pa.array(counts, pa.int64()), picked.column("id"), picked.column("text")], names=["bucket", "guest", "missing", "down", "hash", "copies", "id", "text"])

    return deal


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a bucket against the one that follows in order."""
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64()), ("copies", pa.int64())])
    held = None

    def result(own: tuple, following: tuple, copies: int) -> tuple:
        _, id_, text, found, _, digest = own
        changed = edited(text, following[2])
        after = signatures(changed)
        return id_, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest, fingerprint(after), likeness(found, after), likeness(found, following[3]), len(found), copies

    for batch in batches:
        out = []
        bucket, guest, copies, ids, texts = (batch.column(c) for c in ("bucket", "guest", "copies", "id", "text"))
        for i in range(batch.num_rows):
            where, id_, text, n = bucket[i].as_py(), ids[i].as_py(), texts[i].as_py() or "", copies[i].as_py()
            visits = guest[i].as_py()
            if held is not None and not visits and held[:3] == (where, id_, text):
                held[4] += n
                continue
            if visits and (held is None or held[0] != where):
                continue  # another copy of the guest
            found = signatures(text)
            own = [where, id_, text, found, n, fingerprint(found)]
            if held is not None:
                out.append(result(held, own, 1))
                if held[4] > 1:
                    out.append(result(held, held, held[4] - 1))
            held = None if visits else own
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def against_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and its likeness to both the edited text and the next one."""
    spark = docs.sparkSession
    id_, text = col(id_column).cast("long"), F.coalesce(col(text_column), F.lit(""))
    rows = docs.select(id_.isNull().alias("missing"), F.coalesce(F.bitwise_not(id_), F.lit(0)).alias("down"), F.xxhash64(text).alias("hash"), id_.alias("id"), text.alias("text"))
    key = ["missing", "down", "hash"]
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if total is None:
        return spark.createDataFrame([], _COMPARED).drop("copies")
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-total // bucket_bytes)))
    # the least key of each range: as many rows as there are buckets
    least = rows.select(*key).repartitionByRange(buckets, *key).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*key)).alias("least")).collect()
    cuts = sorted(tuple(r["least"]) for r in least)
    dealt = rows.mapInArrow(_dealt(cuts), schema_of(_KEYED))
    ordered = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", *key, "text")
    compared = ordered.mapInArrow(_compare, schema_of(_COMPARED))
    return compared.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


# --------------------------------------------------------------------------- all pairs alike


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(``id``, ``fingerprint``, ``signatures``): the signatures in order."""
    schema = pa.schema([("id", pa.int64()), ("fingerprint", pa.string()), ("signatures", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                sets = [signatures(t) for t in own.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(map(fingerprint, sets), pa.string()), pa.array([[s.decode() for s in sorted(x)] for x in sets], schema[2].type)], schema=schema)

    return docs.select(col(id_column).cast("long").alias("id"), col(text_column).alias("text")).mapInArrow(work, schema_of("id long, fingerprint string, signatures array<string>"))


def linked(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(``left``, ``right``, ``likeness``): pairs of different fingerprints, ``left`` the smaller, with likeness of ``threshold`` or more.

    ``found`` is what ``fingerprints`` returns; it also tells which rows have a fingerprint.
    """
    sets = cut(found.groupBy("fingerprint").agg(F.any_value("signatures").alias("signatures")).where(F.size("signatures") > 0))
    each = sets.select("fingerprint", F.size("signatures").alias("n"), F.explode("signatures").alias("signature"))
    rarity = each.groupBy("signature").agg(F.count("*").alias("sets"))
    rare = each.join(rarity.where(F.col("sets") > 1), "signature")  # what one set alone has, no pair can meet over
    ordered = rare.groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "signature"))).alias("shared"))
    # a pair shares ceil(threshold * n) signatures; those that one set alone has are misses already
    spare = F.col("n") - F.ceil(F.col("n") * threshold - F.lit(1e-9)) - (F.col("n") - F.size("shared")) + 1
    partition = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + F.lit(1e-9))
    posted = ordered.where(spare > 0).select("fingerprint", "n", partition.alias("part"), F.explode(F.slice("shared", 1, spare.cast("int"))).alias("entry"))
    posted = cut(posted.select("fingerprint", "n", "part", F.col("entry.signature").alias("signature")))
    left = posted.select(F.col("fingerprint").alias("a"), F.col("n").alias("n_a"), "signature", F.col("part").alias("meets"), F.col("part").alias("part_a"))
    right = posted.select(F.col("fingerprint").alias("b"), F.col("n").alias("n_b"), "signature", F.explode(F.array("part", F.col("part") - 1)).alias("meets"), F.col("part").alias("part_b"))
    once = (F.col("part_a") < F.col("part_b")) | (F.col("a") < F.col("b"))
    long_enough = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - F.lit(1e-9)
    pairs = left.join(right, ["signature", "meets"]).where((F.col("a") != F.col("b")) & once & long_enough).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()
    of = lambda name: sets.select(F.col("fingerprint").alias(name), F.col("signatures").alias(f"{name}_set"))
    both = F.size(F.array_intersect("left_set", "right_set"))
    measured = pairs.join(of("left"), "left").join(of("right"), "right").withColumn("likeness", both / (F.size("left_set") + F.size("right_set") - both))
    return measured.where(F.col("likeness") >= threshold - 1e-9).select("left", "right", "likeness")
