"""The queries opN_<name> of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from weft.llm import audit, bitpack, html, mixing, online, packing, quality, sharding, simhash, tiff, tokencount, warc, whitening

QUERIES = {f.__name__: f for f in (
    packing.op1_best_fit_packing,
    warc.op2_content_addressed_warc,
    sharding.op3_rendezvous_sharding,
    quality.op4_isolation_forest_rules,
    tiff.op5_tiff_media,
    mixing.op6_source_mixing,
    tokencount.op7_separator_scan,
    simhash.op8_simhash_near_duplicates,
    bitpack.op9_bit_packed_ids,
    html.op10_site_template_removal,
    audit.op11_filter_interactions,
    whitening.op12_svd_whitening,
    online.op13_bounded_space_packing,
)}
ORACLES = {"op11_filter_interactions": audit.OP11_SQL}
