"""Parameters shared by the Spark workloads and their SQL counterparts."""

from __future__ import annotations

# Words that mark a language; used as a transparent stand-in for a trained classifier wherever
# the expected result is to be computed in SQL as well.
MARKER_WORDS = {
    "de": ("der", "die", "und", "das"),
    "en": ("the", "of", "to", "is"),
    "es": ("el", "los", "y", "del"),
    "fr": ("le", "les", "et", "une"),
}

# Substrings that route a request in the test tables, which hold none of the default ones.
ROUTE_MARKERS = ("the ", " der ", "que ")

ALLOW_LIST = ("src7", "src12", "src3", "src0")

DIMENSIONS = 64
TOP_N = 5
MODEL_BLOCK = 64
