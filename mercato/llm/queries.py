"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm import (
    decontaminate, embedding_neardup, filter_audit, html_wrapper, langid, minhash, mixing, onebit_search, sharding, suffix_dedup,
    token_planes, toxicity, turn_repair,
)
from mercato.llm.common import shared_folder, table


def op7_noisy_channel_toxicity(spark, sf_dir) -> DataFrame:
    """Toxicity of every document; labels are learned from the folds other than 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    held = langid.in_fold("doc_id", 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return (toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


def op8_wrapper_induction(spark, sf_dir) -> DataFrame:
    """Main text of every page."""
    read = html_wrapper.extract(table(spark, sf_dir, "pages"))
    return read.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_hd_langid(spark, sf_dir) -> DataFrame:
    """Language of every document; fitted on the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    held = langid.in_fold("doc_id", 4, 2)
    prototypes = langid.fit(docs.where(~held))
    return (langid.classify(docs.select("doc_id", held.alias("held_out"), "text"), prototypes)
            .select("doc_id", "held_out", "lang_pred", "score"))


def op1_pigeonhole_join(spark, sf_dir) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_plane_tokens(spark, sf_dir) -> DataFrame:
    """Token ids of all documents, written in plane files and read back."""
    import public_tokenizers

    manifest = token_planes.write(table(spark, sf_dir, "documents"), shared_folder(spark, "planes"),
                                  public_tokenizers.path("byte_bpe_50k.json"))
    return token_planes.read(spark, manifest).withColumnRenamed("id", "doc_id")


def op4_circulant_minhash(spark, sf_dir) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles."""
    docs = table(spark, sf_dir, "documents")
    return (minhash.near_duplicates(docs, p=minhash.Params(width=2))
            .select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept"))


def op5_simhash_decontamination(spark, sf_dir) -> DataFrame:
    """One row per document and benchmark item that a window of the document matches."""
    marked = decontaminate.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op6_karmarkar_karp(spark, sf_dir) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return sharding.shard_rows(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_hypergeometric_mix(spark, sf_dir) -> DataFrame:
    """Words that the mix takes of each document, and the shard and place of every copy taken."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    drawn = mixing.in_places(mix.draws).groupBy("source_no", "slot").agg(
        F.sum("size").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "place"))).alias("places"))
    return (mix.plan.join(drawn, ["source_no", "slot"], "left")
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.coalesce("places", F.array().cast("array<struct<shard:int,place:bigint>>")).alias("places")))


def op11_rotated_onebit_search(spark, sf_dir) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 50."""
    codes = onebit_search.index(table(spark, sf_dir, "embeddings"))
    return onebit_search.search(codes, F.col("id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def op12_survivor_viterbi(spark, sf_dir) -> DataFrame:
    """Every conversation damaged and repaired."""
    return turn_repair.audit(table(spark, sf_dir, "conversations"))


def op13_failing_id_audit(spark, sf_dir) -> DataFrame:
    """Five filters in all 120 orders, for every source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_pigeonhole_join": op1_pigeonhole_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_plane_tokens": op3_plane_tokens,
    "op5_simhash_decontamination": op5_simhash_decontamination,
    "op6_karmarkar_karp": op6_karmarkar_karp,
    "op10_hypergeometric_mix": op10_hypergeometric_mix,
    "op4_circulant_minhash": op4_circulant_minhash,
    "op7_noisy_channel_toxicity": op7_noisy_channel_toxicity,
    "op8_wrapper_induction": op8_wrapper_induction,
    "op9_hd_langid": op9_hd_langid,
    "op11_rotated_onebit_search": op11_rotated_onebit_search,
    "op12_survivor_viterbi": op12_survivor_viterbi,
    "op13_failing_id_audit": op13_failing_id_audit,
}

ORACLES: dict[str, str] = {
    "op11_rotated_onebit_search": onebit_search.ORACLE,
    "op13_failing_id_audit": filter_audit.ORACLE,
}
