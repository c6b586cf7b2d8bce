"""The queries of this subpackage, by the name under which the driver finds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from runlake.llm import ball_clusters, decontaminate, linkgraph, preference, secrets, vector_codes
from runlake.llm.ann_tree import op1_ann_tree
from runlake.llm.ball_clusters import op12_ball_kmeans
from runlake.llm.decontaminate import op3_decontaminate
from runlake.llm.importance import op4_importance
from runlake.llm.langid import op7_langid
from runlake.llm.linkgraph import op5_linkgraph
from runlake.llm.packing import op9_packing
from runlake.llm.preference import op10_preference
from runlake.llm.secrets import op8_secret_scan
from runlake.llm.simhash_anchor import op2_simhash
from runlake.llm.token_store import op6_token_store
from runlake.llm.toxicity import op13_toxicity
from runlake.llm.vector_codes import op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_ann_tree, op2_simhash, op3_decontaminate, op4_importance, op5_linkgraph, op6_token_store, op7_langid, op8_secret_scan, op9_packing, op10_preference, op11_vector_codes, op12_ball_kmeans, op13_toxicity)
    parts = (linkgraph.url_rules, secrets.secret_counts)  # of op5 and op8: what SQL can express of them
    return {f.__name__: f for f in (*each, *parts)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against brute force, round trips or held-out rows."""
    return {"op3_decontaminate": decontaminate.ORACLE, "op10_preference": preference.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_ball_kmeans": ball_clusters.ORACLE, "url_rules": linkgraph.RULES_ORACLE, "secret_counts": secrets.COUNTS_ORACLE}
