"""The registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm import decontamination, hard_negatives, mixing, periodic_runs, permutation_index, quality, secrets, sharding, simhash, spotsigs, suffix_dedup, token_output, warc
from tabaudit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", F.col("n").alias("item_shingles"), "containment")


#: Containment by definition: all shingles of all documents against those of the items.
SQL["op1_decontamination"] = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
ii AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM ii),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM dw, (SELECT DISTINCT k FROM ii) WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS matched, any_value(n.n) AS item_shingles, count(*) / any_value(n.n) AS containment
FROM d JOIN i USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * any_value(n.n) - 1e-9)"""


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.identifiers(docs))
    kinds = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    counts = [F.size(kinds(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.sha2(secrets.digest(kinds(*secrets.KINDS[:3])), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *counts[:3], base, secrets.digest(F.col("spans")).alias("spans"), counts[3])


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives.files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_output.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_output.read_token_files(files)


@query
def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.bounded_ring(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, names = mixing.mix(table(spark, sf_dir, "documents"))
    size, copies = F.col(names["size"]), F.col(names["copies"])
    return mixed.select("doc_id", size.alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), (size * copies).alias("taken"))


#: Sources in order share all words by weight 1, 2, 3; those above their limit are a prefix by limit over weight.
SQL["op9_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source IS NULL, encode(source)) AS k, sum(source_size) OVER () AS total FROM r),
p AS (SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM o),
f AS (SELECT rest::BIGINT AS rest, open_weight::BIGINT AS open_weight, k AS first_open FROM p WHERE weight * rest <= 3 * source_size * open_weight ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k < f.first_open THEN (3 * o.source_size)::DOUBLE ELSE (o.weight * f.rest)::DOUBLE / f.open_weight::DOUBLE END AS target FROM o, f),
m AS (SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null'))[1:12])::BIGINT::DOUBLE / 281474976710656.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, names = quality.scored(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    score = F.col(names["score"])
    return rows.select("doc_id", F.col(names["text_score"]).alias("text_score"), F.col(names["metadata_score"]).alias("metadata_score"), score.alias("score"), quality.keep(score).alias("keep"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("id") % 100 == 0)


#: Every anchor against every row.
SQL["op11_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, c.label = a.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT anchor_id, p.k::INT AS positive_rank, p.id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.k ORDER BY s.score DESC, s.id))::INT AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10"""


@query
def op12_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = spotsigs.against_next(table(spark, sf_dir, "documents"))
    return compared.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures")


_ANCHOR_LIST = ", ".join(f"'{w}'" for w in sorted(spotsigs.ANCHORS))
#: Signatures from positions of words: an anchor's chain begins at the first content word behind it.
SQL["op12_spotsigs"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, coalesce(lead(doc_id) OVER q, first_value(doc_id) OVER q) AS next_id, coalesce(lead(t) OVER q, first_value(t) OVER q) AS f FROM d WINDOW q AS (ORDER BY doc_id DESC)),
e AS (SELECT *, left(t, length(t) - length(t) // 3) || left(f, length(t) // 3) AS changed FROM o),
texts AS (SELECT doc_id, 'own' AS kind, t FROM e UNION ALL SELECT doc_id, 'edited', changed FROM e),
w AS (SELECT doc_id, kind, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM texts),
r AS (SELECT doc_id, kind, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
m AS (SELECT *, count_if(NOT spot) OVER (PARTITION BY doc_id, kind ORDER BY i) AS behind FROM (SELECT *, word IN ({_ANCHOR_LIST}) AS spot FROM r) a),
c AS (SELECT doc_id, kind, behind AS k, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS chain FROM m WHERE NOT spot WINDOW p AS (PARTITION BY doc_id, kind ORDER BY i)),
s AS (SELECT DISTINCT m.doc_id, m.kind, m.word || ' ' || c.chain AS sig FROM m JOIN c ON c.doc_id = m.doc_id AND c.kind = m.kind AND c.k = m.behind + 1 WHERE m.spot AND c.chain IS NOT NULL),
z AS (SELECT DISTINCT doc_id, kind, array_to_string(w[i + 1:i + 4], ' ') AS sig FROM (SELECT *, unnest(range(greatest(1, len(w) - 3))) AS i FROM w ANTI JOIN s USING (doc_id, kind) WHERE len(w) > 0) y),
x AS (SELECT * FROM s UNION ALL SELECT * FROM z),
p AS (SELECT doc_id, kind, sha256(string_agg(sig, chr(10) ORDER BY sig)) AS print, count(*) AS n FROM x GROUP BY ALL),
t2 AS (SELECT e.*, coalesce(a.print, sha256('')) AS own_print, coalesce(a.n, 0) AS own_n, coalesce(b.print, sha256('')) AS new_print, coalesce(b.n, 0) AS new_n, coalesce(f.n, 0) AS next_n
       FROM e LEFT JOIN p a ON a.doc_id = e.doc_id AND a.kind = 'own' LEFT JOIN p b ON b.doc_id = e.doc_id AND b.kind = 'edited' LEFT JOIN p f ON f.doc_id = e.next_id AND f.kind = 'own'),
be AS (SELECT a.doc_id, count(*) AS k FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.sig = b.sig WHERE a.kind = 'own' AND b.kind = 'edited' GROUP BY a.doc_id),
bn AS (SELECT e.doc_id, count(*) AS k FROM e JOIN x a ON a.doc_id = e.doc_id AND a.kind = 'own' JOIN x b ON b.doc_id = e.next_id AND b.kind = 'own' AND b.sig = a.sig GROUP BY e.doc_id)
SELECT doc_id, length(t) AS n_chars, sha256(changed) AS edited_sha256, own_print AS fingerprint, new_print AS edited_fingerprint,
  CASE WHEN own_n + new_n = 0 THEN 1.0 ELSE coalesce(be.k, 0) / (own_n + new_n - coalesce(be.k, 0)) END AS near_edited,
  CASE WHEN own_n + next_n = 0 THEN 1.0 ELSE coalesce(bn.k, 0) / (own_n + next_n - coalesce(bn.k, 0)) END AS near_next, own_n AS n_signatures
FROM t2 LEFT JOIN be USING (doc_id) LEFT JOIN bn USING (doc_id)"""


def repeating_tail(ids: pa.Array, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edit of the contract: every tenth document by the checksum of its id repeats a period from some word on; null ids stay."""
    h = np.array([1 if i is None else zlib.crc32(str(i).encode()) for i in ids.to_pylist()], np.int64)
    g = h // 10
    start = g % np.maximum(n_words, 1)
    return start, np.where((h % 10 == 0) & (n_words > 0), 1 + (n_words - start) // (3 + g % 8), 0)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(table(spark, sf_dir, "documents"), rewrite=repeating_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length, start, period = longest["length"], -longest["start"], -longest["period"]
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
