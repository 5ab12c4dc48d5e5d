"""The thirteen pipeline operators' queries, as the driver calls them."""

from strandlab.llm import clustering, merkle
from strandlab.llm.fingerprints import fingerprints
from strandlab.llm.langid import languages
from strandlab.llm.licenses import license_scan
from strandlab.llm.linededup import line_dedup
from strandlab.llm.mixing import mixture
from strandlab.llm.neardup import near_duplicates
from strandlab.llm.packing import pack
from strandlab.llm.quality import quality
from strandlab.llm.rules import quality_rules
from strandlab.llm.tokencounts import token_counts
from strandlab.llm.toxicity import toxicity

QUERIES = {
    "op1_best_fit_packing": pack,
    "op2_line_dedup": line_dedup,
    "op3_mixing": mixture,
    "op4_quality_classifier": quality,
    "op5_toxicity": toxicity,
    "op6_quality_rules": quality_rules,
    "op7_token_counts": token_counts,
    "op8_fingerprints": fingerprints,
    "op9_ngram_jaccard": near_duplicates,
    "op10_license_scan": license_scan,
    "op11_centroid_clusters": clustering.clusters,
    "op12_merkle_manifest": merkle.merkle,
    "op13_language_id": languages,
}
ORACLES = {"op11_centroid_clusters": clustering.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
