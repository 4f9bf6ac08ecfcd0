"""All registered queries of the training-data operators."""

from paperloom.llm import collocations, decontam, fingerprint, html_text, language, merkle, mixture, pieces, pii, simhash, suffix, token_store, url_filter  # noqa: F401
from paperloom.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
