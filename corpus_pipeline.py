"""The corpus pipeline: documents in, a weighted training mix out.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` whose rows are written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from quarrystat.llm import decontam, line_dedup, mixing, near, quality
from quarrystat.llm.common import saved, table


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_stage(spark, docs, sf_dir):
    """Repeated lines stay in their first document only."""
    return line_dedup.without_repeated_lines(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates: the smallest id.

    SimHash first: fingerprints of three-word shingles at most two bits apart are links, found
    by pigeonring chains as in ``op1_simhash``. Within two of 64 bits lie few of the pairs whose
    five-word shingles are similar by 0.8, so the exact search adds the others as links, and
    groups are the components of both.
    """
    return near.one_of_each_group(docs, prints=3)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that repeat no benchmark item."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """Every document with its size, its source's target and the words the mix takes."""
    return mixing.mix_report(docs)


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("near dedup", near_dedup_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The quality classifier and the alignment have no SQL form; tests compare with brute force.
ORACLE_SQL = None
