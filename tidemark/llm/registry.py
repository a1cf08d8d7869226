"""All queries of this subpackage and their SQL."""

from . import bpe, jaccard, langid, licenses, packing, pii, quality, repair, repeats, sharding, tokenfile, topk, whitening

_MODULES = (quality, topk, licenses, repeats, bpe, jaccard, pii, packing, sharding, tokenfile, repair, whitening, langid)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
