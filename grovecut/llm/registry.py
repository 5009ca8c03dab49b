"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact, fingerprints, mixing, ngramjoin, packing, pii, suffixes, toxicity, urls, wrappers

QUERIES = {
    f.__name__: f
    for f in (
        suffixes.op1_suffix_dedup,
        pii.op2_pii,
        fingerprints.op3_fingerprints,
        ngramjoin.op4_ngram_join,
        packing.op5_packing,
        urls.op6_url_filter,
        exact.op7_exact_dedup,
        wrappers.op8_html_wrappers,
        toxicity.op9_toxicity,
        mixing.op10_mixing,
    )
}

SQL = {
    "op1_suffix_dedup": suffixes.SQL,
    "op4_ngram_join": ngramjoin.SQL,
    "op6_url_filter": urls.SQL,
    "op7_exact_dedup": exact.SQL,
    "op10_mixing": mixing.SQL,
}
