"""Corpus preparation in five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm import toxicity
from plyforge.llm.bpe import tokenized
from plyforge.llm.minhash import NearDupParams, near_duplicates
from plyforge.llm.mixing import mix, mixed_order
from plyforge.llm.pii import pseudonymize
from plyforge.llm.queries import PII, TARGET, id_rest, vocabulary
from plyforge.llm.textio import documents, materialize

#: A trained classifier, hashed similarity joins and a merge loop: SQL can't express these stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, doesn't reject at 0.3.

    Rows whose text is null or empty stay, as do rows without an id; repeated rows stay or go together. An empty table stays
    empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_rest(4) != 2)
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the one with the smallest id.

    Repeated rows of an id leave one row, the one with the least hash of all its columns; rows without an id can't be told
    apart as documents and stay. Null and empty texts are linked with nothing. An empty table stays empty.
    """
    groups = near_duplicates(docs, NearDupParams(words=5, percent=80), count_links=False)
    keep = groups.where("kept").select("doc_id").distinct()
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id").join(keep.hint("merge"), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("row")))
    rows = rows.withColumn("nth", first).where("nth = 1").select("row.*")
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with format-preserving pseudonyms; n_chars follows the text. Every row stays, null and empty texts
    as they are."""
    out = pseudonymize(docs, PII)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix: every written file is one run of it. What reads them anew can't tell.

    Every row stays, repeated ones side by side; null and unlisted sources come last.
    """
    return mixed_order(docs, TARGET)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, position, in_mix, n_tokens, ids and round_trip of every document, sorted by position.

    Files are read in an order of their own, so the mix, which the rows alone decide, is computed again. Null text counts as
    empty: no ids. An empty table gives an empty result.
    """
    mixed = mix(docs, TARGET).orderBy("position").select("row.doc_id", "row.lang", "row.source", "position", "in_mix", "row.text")
    return tokenized(mixed, vocabulary("byte_bpe_50k.json"), ("doc_id", "lang", "source", "position", "in_mix"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
