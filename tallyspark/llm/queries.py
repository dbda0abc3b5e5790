"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op4_nearest
from .bpe_codec import op9_bpe_codec
from .centroids import op11_clusters
from .decontaminate import op2_decontamination
from .license_scan import op1_license_scan
from .lm_score import op10_lm_score
from .near_dups import op8_near_duplicates
from .oracle import SQL
from .packing import op12_pack
from .quality import op7_quality_rank
from .ranked_search import op13_ranked_search
from .secret_scan import op3_secret_scan
from .token_counts import op6_token_counts
from .toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_secret_scan, op4_nearest, op5_toxicity, op6_token_counts, op7_quality_rank, op8_near_duplicates, op9_bpe_codec, op10_lm_score, op11_clusters, op12_pack, op13_ranked_search)}
ORACLE_SQL: dict[str, str] = SQL
