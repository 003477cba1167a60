"""The queries of the operators and, where SQL can state them, their SQL."""

from . import collocations, exact_dedup, licenses, mixing, near_dedup, neighbours, packing, piece_encoding, quality, secrets, sharding, token_counts, whitening

MODULES = (exact_dedup, secrets, piece_encoding, neighbours, near_dedup, token_counts, quality, mixing, packing, sharding, collocations, licenses, whitening)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
