"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import delta_lloyd, url_filter
from quern.llm.decontaminate import op8_decontamination
from quern.llm.fingerprint import op9_fingerprints
from quern.llm.lm import op7_lm_score
from quern.llm.ngram_join import op1_ngram_jaccard_join
from quern.llm.packing import op2_best_fit_packing
from quern.llm.pattern_packing import op12_pattern_packing
from quern.llm.pii import op4_pii
from quern.llm.quality import op5_quality
from quern.llm.resample import op11_importance_resampling
from quern.llm.secrets import op10_secrets
from quern.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_lm_score": op7_lm_score,
    "op8_decontamination": op8_decontamination,
    "op9_fingerprints": op9_fingerprints,
    "op10_secrets": op10_secrets,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_pattern_packing": op12_pattern_packing,
    "op13_centroid_clustering": delta_lloyd.op13_centroid_clustering,
}
ORACLES: dict[str, str] = {"op6_url_filter": url_filter.SQL, "op13_centroid_clustering": delta_lloyd.SQL}
