"""The query of the pipeline at the top of the repository."""

import corpus_pipeline

from ..plans.registry import query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
