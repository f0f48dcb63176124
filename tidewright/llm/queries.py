"""Queries of the text operators (p7 to p9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.mixing import mix
from tidewright.llm.residue import find_residue, without_residue
from tidewright.llm.tokens import decode, encode
from tidewright.plans.registry import Registry, table

R = Registry()


@R.add("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode(table(spark, folder, "documents").select("doc_id", "text"))


@R.add("p7_roundtrip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return decode(p7_ids(spark, folder))


@R.add("p8_mix")
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


@R.add("p8_shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


@R.add("p8_weighted")
def p8_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """A mix in which a document's chance grows with the root of its length: target and reached share of every source."""
    docs = table(spark, folder, "documents").withColumn("w", F.sqrt(F.length("text")))
    return mix(docs, table(spark, folder, "mix_targets"), weight="w")[1]


@R.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold residue instead of content."""
    return find_residue(table(spark, folder, "documents")).select("doc_id").distinct()


@R.add("p9_kept")
def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are left after residue is taken out."""
    return without_residue(table(spark, folder, "documents")).select("doc_id", F.col("source"))
