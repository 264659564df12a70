"""A training corpus from documents, in five stages. Each stage's rows are written before the next reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import mixing, neardup, packing, rules, toxicity
from framewright.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. All stay, texts without words among them, if no label teaches
    what is toxic; repeated rows and rows without an id or a text are judged each."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject. All stay if no label teaches what is good; a null text counts as
    an empty one."""
    return rules.good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id, one row of repeated ones; texts without words are
    no duplicates and stay."""
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for each document and pass that takes words of it. Documents without words give none; a
    null source is one like the others."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; each row of docs is packed, whatever its id."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", keep_one_of_each), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Learnt models, sampling by floating point and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
