"""Imports every operator module, so that ``QUERIES`` and ``SQL`` are complete."""

from riskframe.llm import bpe_codec, fingerprints, jaccard_join, language_id, markov_lm, nearest, packing, quality_net, secret_scan, spelling, token_files, url_filter, whitening  # noqa: F401
from riskframe.llm.registry import QUERIES, SQL  # noqa: F401
