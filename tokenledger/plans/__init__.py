"""The registered queries of the library; importing this module registers them."""

from . import decoding, enrichment, ledger, reads, states, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
