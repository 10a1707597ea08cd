"""The queries of this subpackage and their SQL, by name."""

from . import decontamination, fingerprints, html, lm, mixing, periodic, phrases, quality, sharding, similarity, substrings, token_counts, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_main_text": html.op2_main_text,
    "op3_decontaminate": decontamination.op3_decontaminate,
    "op4_lm_score": lm.op4_lm_score,
    "op5_mix": mixing.op5_mix,
    "op6_shard": sharding.op6_shard,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_remove_repeats": substrings.op8_remove_repeats,
    "op9_fingerprint": fingerprints.op9_fingerprint,
    "op10_similar": similarity.op10_similar,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_collocations": phrases.op12_collocations,
    "op13_quality": quality.op13_quality,
}
SQL = {"op3_decontaminate": decontamination.SQL, "op5_mix": mixing.SQL, "op8_remove_repeats": substrings.SQL, "op10_similar": similarity.SQL, "op11_periodic_runs": periodic.SQL, "op12_collocations": phrases.SQL}
