"""The training-data pipeline: toxicity, line dedup, near-dedup, substring dedup, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.best_two_fit import packing_stage
from sparkloom.llm.bottom_k_dedup import near_duplicate_stage
from sparkloom.llm.common import delete, noting, stored, table
from sparkloom.llm.pu_toxicity import toxicity_stage
from sparkloom.llm.suffix_automaton_dedup import substring_stage
from sparkloom.llm.template_dedup import line_stage

#: Folders of the tables that stages stored on their way.
LEFT: list[str] = []


def staged(stage):
    """The stage; before it begins, the tables go that earlier stages stored on their way, unless docs reads them.

    A stage's rows are written before the next one begins, so nothing else does.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in docs.inputFiles()} if LEFT else set()
        done = [path for path in LEFT if path.rsplit("/", 1)[-1] not in read]
        delete(spark, done)
        LEFT[:] = [path for path in LEFT if path not in done]
        with noting(LEFT):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", staged(toxicity_stage)),
    ("line_dedup", staged(line_stage)),
    ("near_dedup", staged(near_duplicate_stage)),
    ("substring_dedup", staged(substring_stage)),
    ("packing", staged(packing_stage)),
]

#: A learnt score and byte-level BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
