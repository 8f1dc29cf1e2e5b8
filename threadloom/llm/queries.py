"""One query per training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import ann, bpe, codes, language, licenses, lines, minhash, mtree, packing, quality, sharding, whitening, winnowing
from .common import id_crc32, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.shards(docs, 8, seed=20240229)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_crc32() % 4 == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"), decoded="decoded").drop("text")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return licenses.scan(docs, tree_path()).drop("source")


def tree_path() -> Column:
    """Documents have no paths: source/ten thousands/thousands/id.txt, and every eighth by CRC-32 is a licence file of one of the three levels."""
    part = lambda name, by: F.concat(F.lit(name), F.floor(F.col("doc_id") / by).cast("string"))
    folders = F.array(F.coalesce("source", F.lit("none")), part("a", 10_000), part("b", 1_000))
    name, crc = F.col("doc_id").cast("string"), id_crc32()
    own = F.concat_ws("/", F.slice(folders, 1, (F.floor(crc / 8) % 3 + 1).cast("int")), F.concat(F.lit("LICENSE."), name))
    path = F.when(crc % 8 == 0, own).otherwise(F.concat_ws("/", folders, F.concat(name, F.lit(".txt"))))
    return F.when(F.col("doc_id").isNotNull(), path)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_crc32() % 3 == 1
    model = language.fit(docs.where(~held))
    return language.predict(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"), 32)


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ann, op2_sharding, op3_quality, op4_mtree, op5_packing, op6_minhash, op7_lines, op8_bpe, op9_licenses, op10_language, op11_codes, op12_whitening, op13_winnowing)}


def _codes_sql() -> str:
    """The rounds written out over rows (part of a vector) and (entry)."""
    steps = ["""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS x FROM k, range(4) r(part)),
 b0 AS MATERIALIZED (SELECT part, e, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p) WHERE e < 256)"""]
    for r in range(5):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.x) AS x, min(CAST(list_dot_product(p.x, p.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(p.x, b.x) AS BIGINT) * 256 + b.e) AS best FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.part)")
        if r < 4:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT part, e, list(v ORDER BY j) AS x FROM (SELECT part, best % 256 AS e, j, floor(sum(x[j]) / count(*)) AS v FROM a{r}, range(1, 1025) g(j) WHERE j <= len(x) GROUP BY ALL) GROUP BY part, e),"
                f" b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.e = b.e)"
            )
    steps.append("""c AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
 h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)""")
    return "WITH " + ",\n ".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Of the others no SQL says the same: models, draws, searches to double precision, components; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_codes": _codes_sql(),
    "op13_winnowing": f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
 n AS MATERIALIZED (SELECT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k FROM b, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1),
 u AS (SELECT DISTINCT n FROM n), e AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, u WHERE len(w) >= n),
 o AS MATERIALIZED (SELECT doc_id, i, n, k FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM e) WHERE k IN (SELECT k FROM n)),
 t AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
 s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o JOIN n USING (n, k) WHERE item_id IS NOT NULL) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)""",
}
