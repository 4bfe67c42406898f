"""Registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, fingerprints, langid, licenses, minhash, ngram_lm, oracles, packing, periodic, phrases, pii, quality,
               simhash, suffix_dedup)
from .common import crc_mod, load, prepare


def op1_suffix_dedup(spark, sf_dir):
    prepare(spark)
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    prepare(spark)
    return ngram_lm.score(load(spark, sf_dir, "documents"))


def op3_langid(spark, sf_dir):
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs))
    return out.withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))


def op4_decontaminate(spark, sf_dir):
    prepare(spark)
    out = decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_fingerprints(spark, sf_dir):
    prepare(spark)
    return fingerprints.with_neighbours(load(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    prepare(spark)
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    out = quality.grade(docs, quality.fit(docs, load(spark, sf_dir, "labels")))
    held = crc_mod("doc_id", quality.FOLDS) == quality.HELD_OUT
    return out.withColumn("held_out", F.coalesce(held, F.lit(False)))


def op8_pii(spark, sf_dir):
    prepare(spark)
    out = pii.find(load(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", F.col("spans_text").alias("spans"))


def op9_packing(spark, sf_dir):
    prepare(spark)
    return packing.pack(load(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    prepare(spark)
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_periodic_runs(spark, sf_dir):
    prepare(spark)
    return periodic.find_runs(periodic.plant(load(spark, sf_dir, "documents")), collapsed=False)


def op12_minhash(spark, sf_dir):
    prepare(spark)
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op13_phrases(spark, sf_dir):
    prepare(spark)
    return phrases.mine(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_lm_scoring, op3_langid, op4_decontaminate, op5_fingerprints, op6_license_scan, op7_quality,
    op8_pii, op9_packing, op10_simhash, op11_periodic_runs, op12_minhash, op13_phrases)}
ORACLES: dict[str, str] = {"op1_suffix_dedup": oracles.SUFFIX_DEDUP, "op4_decontaminate": oracles.DECONTAMINATE,
                            "op12_minhash": minhash.ORACLE, "op13_phrases": phrases.ORACLE}
