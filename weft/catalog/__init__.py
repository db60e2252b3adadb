"""All registered queries over the driver's tables: importing this module registers them."""

from weft.catalog import analytics, corpus, ledgers, names, notes, pools, records, reports, retrieval, state, stream  # noqa: F401
