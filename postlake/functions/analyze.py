"""Text to lexemes.

Two analyzers: ``simple`` lower-cases and splits; ``english`` also drops stop
words, which keep their positions, and stems.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANALYZERS = ("simple", "english")

# The English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now
""".split()

# Positions stop at MAX_POS, a lexeme keeps that many positions
# per field and in total, and the weight of each field.
MAX_POS = 16383
MAX_FIELD_POSITIONS = 255
MAX_POSITIONS = 256
WEIGHTS = {"title": 1.0, "location": 0.4, "description": 0.2}

SPLIT = r"[^\p{L}\p{N}]+"
MARKUP = r"</?[A-Za-z!][^<>]*>|&#?[A-Za-z0-9]+;"


def check_analyzer(name: str) -> str:
    if name not in ANALYZERS:
        raise ValueError(f"unknown analyzer: {name}")
    return name


def plain_text(c: Column | str) -> Column:
    """Tags and entities of inner HTML are not words, and take no position."""
    return F.regexp_replace(c, MARKUP, " ")


def words(c: Column | str) -> Column:
    """Array of lower-case words in text order."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), SPLIT), "")


def stop_list() -> str:
    """The stop words as a SQL list."""
    return ", ".join(f"'{w}'" for w in STOP_WORDS)


def is_stop(token: Column, analyzer: str) -> Column:
    return token.isin(STOP_WORDS) if analyzer == "english" else F.lit(False)
