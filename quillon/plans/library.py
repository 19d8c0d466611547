"""All queries of the library, by name."""

from . import inference, ingest, longrec, predictions, profiles, redrawn, spectra, wide
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "inference", "ingest", "longrec", "predictions", "profiles", "redrawn", "spectra", "wide"]
