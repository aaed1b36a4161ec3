"""The registered query of each operator: whole table in, digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import bpe, embeddings, langid, licenses, minhash, negatives, packing, phrases, pitman_yor, quality, repeats, secrets, sharding, sql
from veritally.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decode=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def fold(doc_id: str = "doc_id", folds: int = 5):
    """CRC-32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold() != 0), vocabulary("piece_bpe_32k.model"))
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: lambda s: s.kind == kind
    base = F.filter("spans", lambda s: s.kind.isin(*[r.kind for r in secrets.BASE]))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))

    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pitman_yor.score(table(spark, sf_dir, "documents"), learn=fold() != 1)
    return scored.withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.fit(docs, settings=licenses.Settings(sample_lines=None)))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join("families", ",").alias("families"),
        F.round(F.array_max(F.transform("notices", lambda x: x.probability)), 6).alias("probability"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality")
    base = (q.n_words < 50) | (100 * q.n_repeat_words > 50 * q.n_words)
    return quality.measure(docs).select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & (F.size(q.failed) == 0)).alias("kept"),
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.report(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), settings=minhash.Settings(similar=85))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pack": op2_pack,
    "op3_langid": op3_langid,
    "op4_secrets": op4_secrets,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_embeddings": op8_embeddings,
    "op9_repeats": op9_repeats,
    "op10_minhash": op10_minhash,
    "op11_phrases": op11_phrases,
    "op12_negatives": op12_negatives,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {"op7_quality": sql.OP7, "op8_embeddings": sql.OP8, "op10_minhash": sql.OP10, "op11_phrases": sql.OP11, "op12_negatives": sql.OP12}
