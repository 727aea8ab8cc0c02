"""Matching and cover-density rank over the hits of one document.

``hits`` is ``array<struct<p int, t int, w double>>`` sorted by position: the
places where a query term occurs, with the term's number and the field weight.
With the limits of stored positions it is bounded by terms x 256, and so is the
work per document.

An extent is a shortest stretch of hits that satisfies the query. Each adds
``(n / sum(1/w)) / (1 + noise)``, with n hits in the stretch and noise the
positions in it that are not hits (half of n - 1, when the cap on positions
would make that negative). Rank is the sum over extents, after Clarke, Cormack
and Tudhope, "Relevance ranking for one to three term queries" (2000).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import websearch
from postlake.functions.settle import settle

HITS = "array<struct<p:int,t:int,w:double>>"
_MARK = "struct<p:int,c:int,v:double>"
_STATE = f"struct<c:int,v:double,b:int,s:double,m:array<{_MARK}>>"


def _place(i: int) -> str:
    """Column with the positions of term ``i``, ascending."""
    return f"_p{i}"


def _places(tree) -> list[str]:
    return [_place(i) for i in range(len(websearch.terms(tree)))]


def _numbers(tree) -> dict[str, int]:
    return {w: i for i, w in enumerate(websearch.terms(tree))}


def with_places(df: DataFrame, tree) -> DataFrame:
    """Adds one array of positions per query term, taken from ``hits``."""
    names = _places(tree)
    if not names:
        return df
    fields = ", ".join(
        f"'{n}', transform(filter(hits, h -> h.t = {t}), h -> h.p)" for t, n in enumerate(names)
    )
    split = settle(df, "_places", F.expr(f"named_struct({fields})"))
    return split.select(*df.columns, "_places.*")


def fill_places(df: DataFrame, tree) -> DataFrame:
    """Empty arrays where an outer join found no hits."""
    fill = {"hits": F.expr(f"coalesce(hits, CAST(array() AS {HITS}))")}
    fill |= {n: F.expr(f"coalesce({n}, CAST(array() AS array<int>))") for n in _places(tree)}
    return df.withColumns(fill)


def matches(tree) -> Column:
    """The query as a predicate over the columns of :func:`with_places`."""
    number = _numbers(tree)

    def build(node) -> str:
        kind, body = node
        if kind == "term":
            return f"size({_place(number[body])}) > 0"
        if kind == "phrase":
            rest = " AND ".join(f"array_contains({_place(number[w])}, p + {d})" for w, d in body[1:])
            return f"exists({_place(number[body[0][0]])}, p -> {rest})"
        if kind == "not":
            return f"NOT ({build(body)})"
        return "(" + f" {kind} ".join(build(n) for n in body) + ")"

    return F.expr("false" if tree is None else build(tree))


def with_rank(df: DataFrame, tree, name: str) -> DataFrame:
    """Adds the rank of each (matching) row as a double."""
    wanted: list = []
    if tree is not None:
        parts = tree[1] if tree[0] == "and" else (tree,)
        wanted = [p for p in parts if p[0] != "not"]
    if not wanted:
        return df.withColumn(name, F.lit(0.0))
    if not websearch.monotone(tree):
        return _walk(df, tree, name)
    if wanted == [tree] and _one_word_each(tree):
        # Every hit is an extent of its own, worth the weight of its field.
        distinct = "array_distinct(transform(hits, h -> struct(h.p, h.w)))"
        return df.withColumn(name, F.expr(f"aggregate({distinct}, 0D, (acc, e) -> acc + e.w)"))
    pairs = "array_distinct(transform(hits, h -> named_struct('p', h.p, 'i', 1D / h.w)))"
    marked = settle(df, "_entries", F.expr(pairs))
    marked = settle(marked, "_entries", F.expr(_leaf_starts(tree, _leaves(wanted))))
    return marked.withColumn(name, F.expr(_fold(wanted))).drop("_entries")


def _one_word_each(node) -> bool:
    return node[0] == "term" or (node[0] == "or" and all(n[0] == "term" for n in node[1]))


def _leaves(nodes) -> list:
    out: list = []
    for node in nodes:
        out.extend([node] if node[0] in ("term", "phrase") else _leaves(node[1]))
    return list(dict.fromkeys(out))


def _leaf_starts(tree, leaves) -> str:
    """Adds to every entry, per leaf that ends there, the mark of where it begins.

    A mark is the position with the count and the sum of 1/w of the entries
    before it. For a word those two are known while folding, and -1 here.
    """
    number = _numbers(tree)

    def mark(leaf) -> str:
        kind, body = leaf
        if kind == "term":
            here = f"array_contains({_place(number[body])}, e.p)"
            known = "named_struct('p', e.p, 'c', -1, 'v', 0D)"
        else:
            begin = f"(e.p - {body[-1][1]})"
            here = " AND ".join(f"array_contains({_place(number[w])}, {begin} + {d})" for w, d in body)
            before = f"filter(_entries, x -> x.p < {begin})"
            total = "aggregate(transform(b, x -> x.i), 0D, (s, x) -> s + x)"
            known = f"transform(array({before}), b -> named_struct('p', {begin}, 'c', size(b), 'v', {total}))[0]"
        return f"IF({here}, {known}, CAST(NULL AS {_MARK}))"

    marks = ", ".join(mark(leaf) for leaf in leaves)
    return f"transform(_entries, e -> named_struct('p', e.p, 'i', e.i, 'm', array({marks})))"


def _fold(wanted) -> str:
    """One pass over the entries.

    For each leaf the state keeps the mark of its latest occurrence. The latest
    start of a stretch that ends here and satisfies the query is then the least
    (AND) or greatest (OR) of the marks; it is a new extent when it moved.
    ``transform(array(v), x -> ...)[0]`` names a value that is used repeatedly.
    """
    slots = {leaf: i for i, leaf in enumerate(_leaves(wanted))}

    def begin_of(node) -> str:
        if node in slots:
            return f"m[{slots[node]}]"
        kind, body = node
        found = [begin_of(n) for n in body]
        if len(found) == 1:
            return found[0]
        if kind == "or":
            return f"greatest({', '.join(found)})"
        known = " AND ".join(f"{f} IS NOT NULL" for f in found)
        return f"IF({known}, least({', '.join(found)}), NULL)"

    latest = """zip_with(acc.m, e.m, (old, new) -> CASE
        WHEN new IS NULL THEN old
        WHEN new.c < 0 THEN named_struct('p', new.p, 'c', acc.c, 'v', acc.v)
        ELSE new END)"""
    gap = "(e.p - b.p - acc.c + b.c)"
    n = "(acc.c + 1 - b.c)"
    noise = f"IF({gap} < 0, ({n} - 1) DIV 2, {gap})"
    gain = f"{n} / (acc.v + e.i - b.v) / (1 + {noise})"
    state = f"""CAST(named_struct(
        'c', acc.c + 1,
        'v', acc.v + e.i,
        'b', IF(b.p > acc.b, b.p, acc.b),
        's', IF(b.p > acc.b, acc.s + {gain}, acc.s),
        'm', m) AS {_STATE})"""
    begin = begin_of(("and", tuple(wanted)))
    step = f"transform(array({latest}), m -> transform(array({begin}), b -> {state})[0])[0]"
    none = ", ".join(f"CAST(NULL AS {_MARK})" for _ in slots)
    start = f"CAST(named_struct('c', 0, 'v', 0D, 'b', 0, 's', 0D, 'm', array({none})) AS {_STATE})"
    return f"aggregate(_entries, {start}, (acc, e) -> {step}, acc -> acc.s)"


def _all_leaves(node) -> list:
    """Words and phrases of a tree, negated ones included."""
    kind, body = node
    if kind in ("term", "phrase"):
        return [node]
    found = _all_leaves(body) if kind == "not" else [leaf for n in body for leaf in _all_leaves(n)]
    return list(dict.fromkeys(found))


def _named(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _walk(df: DataFrame, tree, name: str) -> DataFrame:
    """The rank for any tree, NOT below OR included, as one fold over the positions of a document.

    A stretch is judged by where its words and phrases first begin, or last end. From a start, the truth of the query can
    change only where a leaf first occurs, so the least of these places at which it is true ends the stretch; likewise the
    greatest place at which it still holds, looking back from the end, begins it. The next start lies behind that.
    """
    number, leaves = _numbers(tree), _all_leaves(tree)
    starts, spans = [], []
    for kind, body in leaves:
        if kind == "term":
            starts.append(_place(number[body]))
            spans.append(0)
        else:
            rest = " AND ".join(f"array_contains({_place(number[w])}, p + {d})" for w, d in body[1:])
            starts.append(f"filter({_place(number[body[0][0]])}, p -> {rest})")
            spans.append(body[-1][1])
    marked = settle(df, "_leaves", F.expr(f"array({', '.join(starts)})"))
    marked = settle(marked, "_entries", F.expr("array_distinct(transform(hits, h -> named_struct('p', h.p, 'i', 1D / h.w)))"))

    def truth(node, present: str) -> str:
        if node in leaves:
            return f"coalesce({present.format(j=leaves.index(node))}, false)"
        kind, body = node
        if kind == "not":
            return f"NOT {truth(body, present)}"
        return "(" + f" {kind} ".join(truth(n, present) for n in body) + ")"

    ends = ", ".join(f"array_min(filter(_leaves[{j}], x -> x >= q)) + {d}" for j, d in enumerate(spans))
    begins = ", ".join(f"array_max(filter(_leaves[{j}], x -> x <= e - {d}))" for j, d in enumerate(spans))
    end = f"array_min(filter(concat(array(q), n), c -> {truth(tree, 'n[{j}] <= c')}))"
    begin = f"array_max(filter(concat(array(e), r), c -> c >= q AND {truth(tree, 'r[{j}] >= c')}))"
    noise = "IF(e - b - size(x) + 1 < 0, (size(x) - 1) DIV 2, e - b - size(x) + 1)"
    gain = f"size(x) / aggregate(x, 0D, (a, y) -> a + y.i) / (1 + {noise})"
    gained = _named("filter(_entries, y -> y.p >= b AND y.p <= e)", "x", f"CAST(acc.s + {gain} AS DOUBLE)")
    moved = _named(f"coalesce({begin}, q)", "b", f"named_struct('q', b + 1, 's', {gained})")
    found = _named(f"array({begins})", "r", moved)
    step = _named(f"array({ends})", "n", _named(end, "e", f"IF(e IS NULL, named_struct('q', 2147483647, 's', acc.s), {found})"))
    places = "array_distinct(transform(_entries, y -> y.p))"
    fold = f"aggregate({places}, named_struct('q', 0, 's', 0D), (acc, q) -> IF(q < acc.q, acc, {step}), acc -> acc.s)"
    return marked.withColumn(name, F.expr(fold)).drop("_entries", "_leaves")
