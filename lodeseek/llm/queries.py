"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodeseek.llm.ann_forest import op13_ann_forest
from lodeseek.llm.decontamination import op2_decontamination
from lodeseek.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from lodeseek.llm.html_extraction import op7_html_text
from lodeseek.llm.language_id import op4_language_id
from lodeseek.llm.lm_scoring import op3_lm_score
from lodeseek.llm.merkle import OP11_SQL, op11_merkle_manifest
from lodeseek.llm.packing import op9_harmonic_packing
from lodeseek.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from lodeseek.llm.secret_scan import op6_secret_scan
from lodeseek.llm.sharding import op1_shuffle_shards
from lodeseek.llm.simhash import op8_simhash
from lodeseek.llm.toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_shuffle_shards,
        op2_decontamination,
        op3_lm_score,
        op4_language_id,
        op5_exact_dedup,
        op6_secret_scan,
        op7_html_text,
        op8_simhash,
        op9_harmonic_packing,
        op10_toxicity,
        op11_merkle_manifest,
        op12_prefix_trie,
        op13_ann_forest,
    )
}

ORACLE = {
    "op5_exact_dedup": OP5_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
