"""The corpus pipeline: stages over documents, each applying one operator of flowsieve.llm.

All stages but the last return the columns of documents. A stage handles what its operator
handles (see the operators' docstrings); an empty table passes through all stages.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm import decontaminate, langid, packing, pii, simhash
from flowsieve.llm.common import load, materialize, prepare

#: A document is rejected when no language is found or none is more likely than this.
LEAST_SCORE = 0.35


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go.

    Without any labelled training row nothing can be judged: only texts that are null or have no letter go.
    """
    prepare(spark)
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = langid.identify(docs, model, keep=True)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (the smallest id, nulls last, then the hash of the text)."""
    prepare(spark)
    return simhash.keep_one_per_group(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    prepare(spark)
    out = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), keep=True)
    return out.where(~F.col("contaminated")).select("row.*")


def redaction(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; n_chars follows the text."""
    prepare(spark)
    out = pii.redact(docs)
    if "n_chars" not in out.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, tokenised and packed into sequences: one row per piece."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("redaction", redaction), ("packing", pack)]
#: Recurrent network and tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and reread."""
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
