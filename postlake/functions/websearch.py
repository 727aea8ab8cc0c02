"""The search-box grammar, turned into a small tree.

Words are joined by AND, ``or`` binds looser, ``-`` negates, quotes make a
phrase. Anything else is punctuation; no input is an error.

A tree is ``("term", lexeme)``, ``("phrase", ((lexeme, offset), ...))``,
``("not", t)``, ``("and", (t, ...))``, ``("or", (t, ...))`` or None for a query
of stop words only, which matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postlake.functions.analyze import check_analyzer, is_stop, words
from postlake.functions.stem import with_stem

_PIECE = re.compile(r'(?P<neg>-)|"(?P<quoted>[^"]*)"?|(?P<word>[^\s"!&|()]+)')


def lexemes(spark: SparkSession, texts: list[str], analyzer: str) -> list[list[tuple[str, int]]]:
    """``(lexeme, position)`` of every text, by the very columns that index documents.

    The plan starts from a literal, so Catalyst folds it and no job runs.
    """
    literal = spark.sql("SELECT posexplode(:texts) AS (n, text)", args={"texts": F.array(*map(F.lit, texts))})
    rows = literal.select("n", F.posexplode(words("text")).alias("pos", "token"))
    rows = rows.where(~is_stop(F.col("token"), check_analyzer(analyzer)))
    if analyzer == "english":
        rows = with_stem(rows, "token", "token")
    out: list[list[tuple[str, int]]] = [[] for _ in texts]
    for row in sorted(rows.collect(), key=lambda r: (r["n"], r["pos"])):
        out[row["n"]].append((row["token"], row["pos"]))
    return out


def _pieces(query: str) -> list[tuple[str, str]]:
    """Flat list of ``("value", text)``, ``("not", "")`` and ``("or", "")``."""
    found: list[tuple[str, str]] = []
    matches = list(_PIECE.finditer(query))
    at = 0
    while at < len(matches):
        m = matches[at]
        start_of_operand = not found or found[-1][0] != "value"
        if m["neg"] is not None:
            found.append(("not", ""))
        elif m["quoted"] is not None:
            found.append(("value", m["quoted"]))
        elif m["word"].lower() == "or" and not start_of_operand and at + 1 < len(matches):
            found.append(("or", ""))
        else:
            found.append(("value", m["word"]))
        at += 1
    return found


def parse(spark: SparkSession, query: str, analyzer: str = "english"):
    pieces = _pieces(query)
    texts = [text for kind, text in pieces if kind == "value"]
    values = iter(lexemes(spark, texts, analyzer) if texts else [])
    alternatives: list[list] = [[]]
    negate = False
    for kind, _ in pieces:
        if kind == "or":
            alternatives.append([])
        elif kind == "not":
            negate = not negate
        else:
            found = next(values)
            node = None
            if len(found) == 1:
                node = ("term", found[0][0])
            elif found:
                node = ("phrase", tuple((w, p - found[0][1]) for w, p in found))
            if node is not None:
                alternatives[-1].append(("not", node) if negate else node)
            negate = False
    groups = [_group("and", nodes) for nodes in alternatives]
    return _group("or", [g for g in groups if g is not None])


def _group(kind: str, nodes: list):
    if not nodes:
        return None
    return nodes[0] if len(nodes) == 1 else (kind, tuple(nodes))


def terms(tree) -> list[str]:
    """Distinct lexemes of a tree, in order of appearance."""
    if tree is None:
        return []
    kind, body = tree
    if kind == "term":
        found = [body]
    elif kind == "phrase":
        found = [w for w, _ in body]
    elif kind == "not":
        found = terms(body)
    else:
        found = [t for node in body for t in terms(node)]
    return list(dict.fromkeys(found))


def holds(tree, present) -> bool:
    """Truth of a tree given ``present(leaf)``."""
    if tree is None:
        return False
    kind, body = tree
    if kind == "not":
        return not holds(body, present)
    if kind in ("and", "or"):
        return (all if kind == "and" else any)(holds(n, present) for n in body)
    return present(tree)


def matches_empty(tree) -> bool:
    """True when a document with none of the terms matches."""
    return holds(tree, lambda leaf: False)


def monotone(tree) -> bool:
    """No NOT but as a direct part of the top-level AND (or the whole query)."""
    if tree is None:
        return True
    kind, body = tree

    def free(node) -> bool:
        return node[0] in ("term", "phrase") or (node[0] in ("and", "or") and all(map(free, node[1])))

    parts = body if kind == "and" else (tree,)
    return all(free(p[1]) if p[0] == "not" else free(p) for p in parts)
