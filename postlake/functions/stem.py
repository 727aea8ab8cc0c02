"""English stemming as Spark columns.

The published Porter2 algorithm, one projection per step. Nothing here runs in
Python per word: every step is a chain of suffix tests inside codegen. The
steps are SQL text, as a long chain costs one call to the JVM that way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions.settle import settle

# Fixed values, from the published description of the algorithm.
WHOLE_WORDS = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP2 = {
    "ization": "ize",
    "ational": "ate",
    "fulness": "ful",
    "ousness": "ous",
    "iveness": "ive",
    "tional": "tion",
    "biliti": "ble",
    "lessli": "less",
    "entli": "ent",
    "ation": "ate",
    "alism": "al",
    "aliti": "al",
    "ousli": "ous",
    "iviti": "ive",
    "fulli": "ful",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "izer": "ize",
    "ator": "ate",
    "alli": "al",
    "bli": "ble",
    "ogi": "og",
    "li": "",
}
STEP3 = {
    "ational": "ate",
    "tional": "tion",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ative": "",
    "ical": "ic",
    "ness": "",
    "ful": "",
}
STEP4 = [
    "ement",
    "ance",
    "ence",
    "able",
    "ible",
    "ment",
    "ant",
    "ent",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
    "ion",
    "al",
    "er",
    "ic",
]

VOWELS = "aeiouy"
_REGION = f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]"
_SHORT = f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$"

# In the SQL below, w is the word so far, s the suffix found for the step at hand
# ('' for none), p the word without it, and r1 and r2 the lengths before the
# regions. The longest suffix decides a step even when its condition then fails.
# Suffixes are told by byte comparison; regular expressions, which cost a
# conversion of the word each, are for the few words that get that far.


def _in(region: str) -> str:
    return f"length(p) >= {region}"


def _swaps(rules: dict[str, str], cond: str) -> tuple[list[str], str]:
    pairs = ", ".join(f"'{suffix}', '{to}'" for suffix, to in rules.items())
    return list(rules), f"IF(s != '' AND {cond}, concat(p, map({pairs})[s]), w)"


def _region_after(text: str) -> str:
    return f"coalesce(nullif(length(regexp_extract({text}, '{_REGION}', 0)), 0), length({text}))"


def _plural() -> tuple[list[str], str]:
    new = f"""CASE s
        WHEN 'sses' THEN concat(p, 'ss')
        WHEN 'ied' THEN concat(p, IF(length(p) > 1, 'i', 'ie'))
        WHEN 'ies' THEN concat(p, IF(length(p) > 1, 'i', 'ie'))
        WHEN 's' THEN IF(p RLIKE '[{VOWELS}].', p, w)
        ELSE w END"""
    return ["sses", "ied", "ies", "us", "ss", "s"], new


def _participle() -> tuple[list[str], str]:
    new = f"""CASE
        WHEN s = '' THEN w
        WHEN s IN ('eed', 'eedly') THEN IF({_in("r1")}, concat(p, 'ee'), w)
        WHEN NOT p RLIKE '[{VOWELS}]' THEN w
        WHEN p RLIKE '(?:at|bl|iz)$' THEN concat(p, 'e')
        WHEN p RLIKE '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$' THEN left(p, length(p) - 1)
        WHEN length(p) = r1 AND p RLIKE '{_SHORT}' THEN concat(p, 'e')
        ELSE p END"""
    return ["eedly", "ingly", "edly", "eed", "ing", "ed"], new


def _final_y() -> tuple[list[str], str]:
    return ["y", "Y"], f"IF(s != '' AND p RLIKE '.[^{VOWELS}]$', concat(p, 'i'), w)"


def _step2() -> tuple[list[str], str]:
    special = "CASE s WHEN 'ogi' THEN endswith(p, 'l') WHEN 'li' THEN p RLIKE '[cdeghkmnrt]$' ELSE true END"
    return _swaps(STEP2, f"{_in('r1')} AND {special}")


def _step3() -> tuple[list[str], str]:
    return _swaps(STEP3, f"{_in('r1')} AND (s != 'ative' OR {_in('r2')})")


def _step4() -> tuple[list[str], str]:
    return _swaps(dict.fromkeys(STEP4, ""), f"{_in('r2')} AND (s != 'ion' OR p RLIKE '[st]$')")


def _step5() -> tuple[list[str], str]:
    drop_e = f"{_in('r2')} OR ({_in('r1')} AND NOT p RLIKE '{_SHORT}')"
    drop_l = f"{_in('r2')} AND endswith(p, 'l')"
    return ["e", "l"], f"CASE s WHEN 'e' THEN IF({drop_e}, p, w) WHEN 'l' THEN IF({drop_l}, p, w) ELSE w END"


def with_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """Adds ``out``, the stem of the lower-case ``word``; other columns pass."""
    kept = [c for c in df.columns if c != out]
    fixed = ", ".join(f"'{a}', '{b}'" for a, b in WHOLE_WORDS.items())
    halt = ", ".join(f"'{x}'" for x in KEPT_AFTER_PLURAL)

    row = df.select(F.struct(*df.columns).alias("row"), F.col(word).alias("word"))
    marked = f"regexp_replace(regexp_replace(word, '^y', 'Y'), '([{VOWELS}])y', '$1Y')"
    row = row.selectExpr("row", "word", f"IF(contains(word, 'y'), {marked}, word) AS w")
    special = "CASE WHEN startswith(w, 'gener') THEN 5 WHEN startswith(w, 'commun') THEN 6 WHEN startswith(w, 'arsen') THEN 5 END"
    row = row.selectExpr("row", "word", "w", f"coalesce({special}, {_region_after('w')}) AS r1")
    row = row.selectExpr("row", "word", "w", "r1", "substring(w, r1 + 1) AS tail")
    row = row.selectExpr("row", "word", "w", "r1", f"IF(tail = '', r1, r1 + {_region_after('tail')}) AS r2")
    for step in (_plural, _participle, _final_y, _step2, _step3, _step4, _step5):
        suffixes, new = step()
        tests = " ".join(f"WHEN endswith(w, '{x}') THEN '{x}'" for x in sorted(suffixes, key=lambda x: -len(x)))
        keep = ["row", "word", "w", "r1", "r2"]
        row = row.selectExpr(*keep, f"CASE {tests} ELSE '' END AS s")
        row = row.selectExpr(*keep, "s", "left(w, length(w) - length(s)) AS p")
        # Some plurals are final: the later steps leave them alone.
        value = new if step is _plural else f"IF(w IN ({halt}), w, {new})"
        row = row.selectExpr("row", "word", f"{value} AS w", "r1", "r2")
        if step in (_plural, _final_y, _step3):
            # A lambda ends a codegen stage. The JIT skips methods of more than
            # 8000 bytes, and one stage for all the steps would be larger.
            row = row.selectExpr("row", "word", "transform(array(w), x -> x)[0] AS w", "r1", "r2")
    row = row.selectExpr(
        "row",
        f"IF(length(word) <= 2, word, coalesce(map({fixed})[word], replace(w, 'Y', 'y'))) AS stem",
    )
    done = settle(row, "stem", F.col("stem"))
    return done.select(*[F.col(f"row.{c}").alias(c) for c in kept], F.col("stem").alias(out))
