"""The training-data pipeline: documents pass five stages, each written and read again as the next one's input.

``run`` gives the windows that the kept text is packed into. No stage can be
expressed in SQL (trained classifier, sketches, suffix order, random balanced
draw, bin packing), so ORACLE_SQL is None; tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm.common import read, table
from terraloom.llm.mixing import mixed
from terraloom.llm.near import deduped
from terraloom.llm.packing import windows
from terraloom.llm.suffix import cut_repeats
from terraloom.llm.toxicity import keep_clean

STAGES = [
    ("toxicity", keep_clean),
    ("near duplicates", deduped),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mixed),
    ("packing", windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents in sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, f"stage-{name.replace(' ', '-')}")
    return docs
