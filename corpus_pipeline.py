"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Toxic documents go, then documents that fail the quality rules (common lines are removed from the rest), then all but
one document of each near-duplicate class; personal data in what is left is sanitised; the rest is packed into
sequences. All stages but the last return the columns of documents.
"""
from __future__ import annotations

import public_tokenizers

from lodestone.llm import near_dedup, packing, pii, quality_rules, toxicity
from lodestone.llm.common import Stash, cut


def toxicity_stage(spark, docs, sf_dir):
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_stage(spark, docs, sf_dir):
    return quality_rules.clean(docs)


def near_dedup_stage(spark, docs, sf_dir):
    return near_dedup.deduplicate(docs)


def pii_stage(spark, docs, sf_dir):
    return pii.sanitise(docs)


def packing_stage(spark, docs, sf_dir):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: The learnt, hashed and tokenised stages have no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written as Parquet in the shared folder and read again; the folder goes at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Stash(spark) as stash:
        before = None
        for _, stage in STAGES:
            docs = stash.put(stage(spark, docs, sf_dir))
            if before is not None:
                stash.drop(before)
            before = docs
        return cut(docs)
