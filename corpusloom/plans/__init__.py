"""Every query of the library with its oracle."""

from . import documents, history, more, retrieval
from .registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Chunks, keyword retrieval and its ten best per question."""
    return retrieval.r4_keyword_leg(spark, sf_dir)
