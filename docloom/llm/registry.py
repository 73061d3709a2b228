"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import decontamination, exact_dedup, language, licenses, nearest, packing, secrets, simhash, spelling, substrings, toxicity, tries, warc

QUERIES = {
    "op1_warc_archives": warc.op1_warc_archives,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_language_id": language.op6_language_id,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_voronoi_knn": nearest.op11_voronoi_knn,
    "op12_prefix_trie": tries.op12_prefix_trie,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op1_warc_archives": warc.ORACLE,
    "op2_license_scan": licenses.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op5_substring_dedup": substrings.ORACLE,
    "op7_secret_scan": secrets.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_voronoi_knn": nearest.ORACLE,
    "op12_prefix_trie": tries.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
