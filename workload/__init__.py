"""Registered queries over the test tables and the SQL that checks them."""

from workload import answers, chunks, corpus, evaluation, finance, pages, retrieval, slots, storage  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
