"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ann, decontam, langid, lm, merkle, mixing, negatives, packing, sharding, simhash, suffix, tokens, toxicity
from tessella.llm.common import id_crc, read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, distance=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learns = id_crc(F.col("doc_id")) % 5 != 0
    model = toxicity.fit(docs.where(learns), labels.where(learns))
    return toxicity.score(docs, model).select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 5 == 1
    model, counts = lm.fit(docs.where(~held_out), F.col("doc_id"))
    return lm.score(docs, model, counts).withColumn("held_out", held_out)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 16)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row in five, by the checksum of its doc_id, is found in lower case."""
    bent = id_crc(F.col("doc_id")) % 5 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.when(F.col("doc_id").isNotNull() & bent, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return merkle.manifest(read(spark, sf_dir, "documents"), found).drop("source")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vec_id are first made wrong."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", moved.cast("long"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, least=80, most=100, scale=256)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end=1).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_toxicity, op3_mixing, op4_suffix_dedup, op5_lm_score, op6_token_counts, op7_language_id, op8_decontamination, op9_nearest, op10_sharding,
        op11_merkle, op12_hard_negatives, op13_packing,
    )
}


def queries() -> dict:
    return dict(QUERIES)


#: Every window of every text, counted; covered bytes as islands of window starts. Hexadecimal text stands for bytes.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
 n AS (SELECT rn, doc_id, hx, length(hx) // 2 AS n FROM d),
 w AS (SELECT rn, i, md5(substr(hx, 2 * i + 1, 400)) AS k FROM (SELECT rn, hx, unnest(range(n - 199)) AS i FROM n WHERE n >= 200)),
 s AS (SELECT rn, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
 g AS (SELECT rn, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rn ORDER BY i) AS g FROM (SELECT rn, i, lag(i) OVER (PARTITION BY rn ORDER BY i) AS before FROM s)),
 r AS (SELECT rn, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rn, g),
 p AS (SELECT r.rn, a, b, coalesce(lag(b) OVER (PARTITION BY r.rn ORDER BY a), 0) AS pre FROM r),
 c AS (SELECT p.rn, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(hx, 2 * pre + 1, 2 * (a - pre)), '' ORDER BY a) AS kept, max(b) AS last FROM p JOIN n ON n.rn = p.rn GROUP BY p.rn)
 SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN c.rn IS NULL THEN hx ELSE kept || substr(hx, 2 * last + 1) END)) AS kept_sha256 FROM n LEFT JOIN c ON c.rn = n.rn
"""


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of doc_id in decimal, bit by bit: each byte, then seven steps more.
CRC_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(doc_id::VARCHAR)), lambda k: [ascii(substr(doc_id::VARCHAR, k::INTEGER + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, e: CASE WHEN xor(c, e) & 1 = 1 THEN xor(xor(c, e) >> 1, 3988292384::BIGINT) ELSE xor(c, e) >> 1 END))"""


def _op11_sql(leaf_levels: int = 8, source_levels: int = 5) -> str:
    """Level by level: nodes of 16, each node's siblings as two strings, rows folded along. A level above the root changes nothing."""
    out = [
        f"l AS (SELECT row_number() OVER () AS rn, doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN {CRC_SQL} % 5 = 0 THEN {_leaf_sql('low')} ELSE {_leaf_sql('text')} END AS now FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents))",
        "p0 AS (SELECT *, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS i FROM l)",
        "t0 AS (SELECT source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM p0)",
    ]

    def climb(tree: str, rows: str, levels: int, by: str) -> None:
        key = f"{by}, " if by else ""
        same = f"s.{by} IS NOT DISTINCT FROM p.{by} AND " if by else ""
        for k in range(levels):
            run = f"OVER (PARTITION BY {key}i // 16 ORDER BY i ROWS BETWEEN"
            out.append(f"s{tree}{k} AS (SELECT {key}i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree}{k})")
            out.append(f"{tree}{k + 1} AS (SELECT {key}i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (max(n) + 15) // 16 AS n FROM {tree}{k} GROUP BY {key}i // 16)")
            out.append(f"{rows}{k + 1} AS (SELECT p.* EXCLUDE (now, proof, i), p.i // 16 AS i, proof || l || r AS proof, CASE WHEN n > 1 THEN sha256(l || now || r) ELSE now END AS now FROM {rows}{k} p JOIN s{tree}{k} s ON {same}s.i = p.i)")

    climb("t", "p", leaf_levels, "source")
    out.append(f"t_ AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{leaf_levels})")
    out.append("u0 AS (SELECT i, h, n FROM t_)")
    out.append(f"q0 AS (SELECT p.* EXCLUDE (i), t_.h AS subroot, t_.i FROM p{leaf_levels} p JOIN t_ ON t_.source IS NOT DISTINCT FROM p.source)")
    climb("u", "q", source_levels, "")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = h AS verified FROM q{source_levels} CROSS JOIN u{source_levels}"


#: Every anchor against every row; integer components, so all sums are exact.
OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.rn AS arn, a.vec_id AS anchor_id, a.label = b.label AS same, b.rn, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.rn <> b.rn WHERE a.vec_id % 100 = 0),
 p AS (SELECT arn, anchor_id, rn AS prn, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arn ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.arn, prn ORDER BY s.score DESC, s.vec_id) AS r FROM p JOIN s ON s.arn = p.arn AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
 SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 5
"""


def oracle_sql() -> dict[str, str]:
    """The other queries' hashes, draws and models have no SQL here; tests/llm holds them against brute force instead."""
    return {"op4_suffix_dedup": OP4_SQL, "op11_merkle": _op11_sql(), "op12_hard_negatives": OP12_SQL}
