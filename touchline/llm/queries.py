"""The operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from .clustering import SQL as CLUSTERING_SQL
from .clustering import op13_centroid_clustering
from .filter_audit import SQL as AUDIT_SQL
from .filter_audit import op12_filter_audit
from .jaccard_join import op5_jaccard_join
from .language_model import op8_lm_scores
from .merge_replay import op9_merge_replay
from .mixture import SQL as MIXTURE_SQL
from .mixture import op4_mix_sources
from .pii import op6_pii
from .quality import op10_quality_rules
from .secrets import op2_secret_scan
from .simhash import op11_simhash_dedup
from .token_counts import op1_token_counts
from .token_files import op7_token_files
from .topk import SQL as TOPK_SQL
from .topk import op3_top_k

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_top_k, op4_mix_sources, op5_jaccard_join, op6_pii, op7_token_files, op8_lm_scores, op9_merge_replay, op10_quality_rules, op11_simhash_dedup, op12_filter_audit, op13_centroid_clustering)}
ORACLES = {"op3_top_k": TOPK_SQL, "op4_mix_sources": MIXTURE_SQL, "op12_filter_audit": AUDIT_SQL, "op13_centroid_clustering": CLUSTERING_SQL}
