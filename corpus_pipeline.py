"""From raw documents to a training mix, stage by stage; every stage works on all that the one before kept.

In every stage null texts count as empty and texts of any length are taken whole; repeated rows are treated alike,
so ties fall the same way everywhere; an empty table gives an empty table; other columns pass through whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontaminate, mixing, secrets, simhash, toxicity
from reelspark.llm.common import prepare, spill, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5; it learns from labels that are not held out.

    A score right at 0.5 is toxic. Empty texts have no hits and are scored by that.
    """
    prepare(spark)
    model, _ = toxicity.train(docs, table(spark, sf_dir, "labels"), whole=False)
    return toxicity.accepted(docs, model, at_least=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (word 5-shingles, similarity 0.8) the document with the least id.

    Documents without words are one group. Rows with a null id stay, as do all rows of an id that stays.
    """
    prepare(spark)
    return simhash.one_of_each(docs, size=5, least=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; those without text hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; ``n_chars``, where there is one, follows. Null texts stay null."""
    prepare(spark)
    before = "before"
    while before in docs.columns:
        before = "_" + before
    found = secrets.redacted(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.drop(before)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that all sources weigh the same, shuffled globally; a null source is a source of its own."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", hide_secrets),
    ("mixing sources", mix_sources),
]

#: No SQL expresses the trained model, the SimHash groups or the alignment: tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill(docs, "stage-" + name.replace(" ", "-"))
    return docs
