"""The queries op1_ to op10_ over the documents table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import langid, toxicity
from plyforge.llm.bpe import bpe_round_trip
from plyforge.llm.huffman import token_files
from plyforge.llm.minhash import NearDupParams, near_duplicates, oracle as links_oracle
from plyforge.llm.mixing import MixParams, mix, oracle as mix_oracle
from plyforge.llm.ogg import media_round_trip
from plyforge.llm.pii import PiiParams, pseudonymize
from plyforge.llm.sharding import shard_documents
from plyforge.llm.simhash import edited_pairs, near_prints
from plyforge.llm.textio import documents


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_rest(n: int) -> Column:
    """crc32 of the document id's decimal text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, id_rest(5) != 0)
    return langid.predict(docs, model).select("doc_id", F.coalesce(id_rest(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_rest(4) != 2)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(id_rest(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


#: A third of the rows may be of src0; the mix gives it a quarter.
TARGET = MixParams({"src0": 0.24} | {f"src{i}": 0.04 for i in range(1, 20)})
PII = PiiParams("corpus-2024")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), PII, found_col="found")
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "source"), TARGET)
    return out.select("row.doc_id", "row.source", "slot", "offset", "position", "in_mix")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_prints(edited_pairs(documents(spark, sf_dir)), 3, F.col("doc_id") % 50 == 0)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 16)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


LINKS = NearDupParams(words=3, percent=85)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), LINKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_pii": op2_pii,
    "op3_mix": op3_mix,
    "op4_bpe": op4_bpe,
    "op5_ogg": op5_ogg,
    "op6_simhash": op6_simhash,
    "op7_shards": op7_shards,
    "op8_token_files": op8_token_files,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
}
ORACLE: dict[str, str] = {"op3_mix": mix_oracle(TARGET), "op9_near_duplicates": links_oracle(LINKS)}
