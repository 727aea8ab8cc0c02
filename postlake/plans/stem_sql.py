"""The published Porter2 algorithm as SQL over a table of words, for the comparison queries."""

from __future__ import annotations

from postlake.functions.stem import KEPT_AFTER_PLURAL, STEP2, STEP3, STEP4, WHOLE_WORDS

_V = "aeiouy"
_SHORT = f"([^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$"
_HALT = ", ".join(f"'{w}'" for w in KEPT_AFTER_PLURAL)


def _region(text: str) -> str:
    found = f"regexp_extract({text}, '^[^{_V}]*[{_V}]+[^{_V}]')"
    return f"CASE WHEN {found} = '' THEN length({text}) ELSE length({found}) END"


def _swap(rules: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{a}' THEN p || '{b}'" for a, b in rules.items()) + " ELSE w END"


#: Suffixes of a step, and the word after it; ``p`` is the word without the longest of them, ``s``.
STEPS = [
    (
        ["sses", "ied", "ies", "us", "ss", "s"],
        f"""CASE WHEN s = 'sses' THEN p || 'ss' WHEN s IN ('ied', 'ies') AND length(p) > 1 THEN p || 'i'
      WHEN s IN ('ied', 'ies') THEN p || 'ie' WHEN s = 's' AND regexp_matches(p, '[{_V}].') THEN p ELSE w END""",
    ),
    (
        ["eedly", "ingly", "edly", "eed", "ing", "ed"],
        f"""CASE WHEN s = '' THEN w
      WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(p) >= r1 THEN p || 'ee' ELSE w END
      WHEN NOT regexp_matches(p, '[{_V}]') THEN w
      WHEN regexp_matches(p, '(at|bl|iz)$') THEN p || 'e'
      WHEN regexp_matches(p, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN p[:-2]
      WHEN length(p) = r1 AND regexp_matches(p, '{_SHORT}') THEN p || 'e' ELSE p END""",
    ),
    (["y", "Y"], f"CASE WHEN s <> '' AND regexp_matches(p, '.[^{_V}]$') THEN p || 'i' ELSE w END"),
    (
        list(STEP2),
        f"""CASE WHEN length(p) < r1 OR (s = 'ogi' AND NOT p LIKE '%l') OR (s = 'li' AND NOT regexp_matches(p, '[cdeghkmnrt]$'))
      THEN w ELSE {_swap(STEP2)} END""",
    ),
    (list(STEP3), f"CASE WHEN length(p) < r1 OR (s = 'ative' AND length(p) < r2) THEN w ELSE {_swap(STEP3)} END"),
    (STEP4, "CASE WHEN s = '' OR length(p) < r2 OR (s = 'ion' AND NOT regexp_matches(p, '[st]$')) THEN w ELSE p END"),
    (
        ["e", "l"],
        f"""CASE WHEN s = 'e' AND (length(p) >= r2 OR (length(p) >= r1 AND NOT regexp_matches(p, '{_SHORT}'))) THEN p
      WHEN s = 'l' AND length(p) >= r2 AND p LIKE '%l' THEN p ELSE w END""",
    ),
]


def stem_ctes(words: str, out: str) -> str:
    """CTEs from ``words(word)`` to ``out(word, stem)``."""
    ctes = [
        f"""marked AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([{_V}])y', '\\1Y', 'g') AS w FROM {words})""",
        f"""regions AS (SELECT word, w, CASE WHEN w LIKE 'gener%' OR w LIKE 'arsen%' THEN 5 WHEN w LIKE 'commun%' THEN 6
      ELSE {_region("w")} END AS r1 FROM marked)""",
        f"step0 AS (SELECT word, w, r1, r1 + {_region('w[r1 + 1:]')} AS r2 FROM regions)",
    ]
    for n, (suffixes, new) in enumerate(STEPS):
        longest = "|".join(sorted(suffixes, key=len, reverse=True))
        value = new if n == 0 else f"CASE WHEN w IN ({_HALT}) THEN w ELSE {new} END"
        ctes.append(f"cut{n} AS (SELECT *, regexp_extract(w, '({longest})$') AS s FROM step{n})")
        ctes.append(f"part{n} AS (SELECT *, left(w, length(w) - length(s)) AS p FROM cut{n})")
        ctes.append(f"step{n + 1} AS (SELECT word, {value} AS w, r1, r2 FROM part{n})")
    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in WHOLE_WORDS.items())
    ctes.append(
        f"""{out} AS MATERIALIZED (SELECT word, CASE WHEN length(word) <= 2 THEN word
      ELSE CASE word {whole} ELSE replace(w, 'Y', 'y') END END AS stem FROM step{len(STEPS)})"""
    )
    return ",\n".join(ctes)
