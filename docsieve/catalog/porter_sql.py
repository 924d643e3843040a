"""The stemming rules as a chain of SQL steps, with regular expressions for the
letter classes.  It shares the suffix tables with the Arrow function, not its logic."""

from __future__ import annotations

from ..functions.stemming import IRREGULAR, STEP2, STEP3, STEP4

_VOWELS = r"^([aeiou]+|[^aeiou][^aeiouy]*[aeiouy][aeiou]*)"  # up to the end of the first vowel run
_Y_CONSONANT = r"((^|[aeiou])y(yy)*|[^aeiouy](yy)+)"  # a run of y whose last one is a consonant


def _cut(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _m0(w: str) -> str:
    return f"regexp_matches({w}, '{_VOWELS}[^aeiou]')"


def _m1(w: str) -> str:
    return f"regexp_matches({w}, '{_VOWELS}[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]')"


def _has_vowel(w: str) -> str:
    return f"regexp_matches({w}, '^([aeiou]|[^aeiou][^aeiouy]*[aeiouy])')"


def _ends_consonant(w: str) -> str:
    return f"regexp_matches({w}, '([^aeiouy]|{_Y_CONSONANT})$')"


def _short_end(w: str) -> str:
    before = rf"([^aeiouy][aeiou]|{_Y_CONSONANT}[aeiou]|[^aeiouy]y(yy)*|(^|[aeiou])(yy)+)"
    return (
        f"(regexp_matches({w}, '^[aeiou][^aeiou]$') OR "
        f"(length({w}) > 2 AND regexp_matches({w}, '{before}[^aeiouwxy]$')))"
    )


def _rules(rules, ok) -> str:
    """First suffix that fits decides, whether or not its condition holds."""
    whens = []
    for old, new in rules:
        keep = _cut("w", len(old))
        whens.append(f"WHEN suffix(w, '{old}') THEN CASE WHEN {ok(old, keep)} THEN {keep} || '{new}' ELSE w END")
    return "CASE " + " ".join(whens) + " ELSE w END"


def _step4_ok(old: str, keep: str) -> str:
    extra = f" AND right({keep}, 1) IN ('s', 't')" if old == "ion" else ""
    return _m1(keep) + extra


def stem_ctes(source: str) -> str:
    """CTEs ending in stemmed(token, n, stem) from ``source(token, n)``."""
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    logi = _cut("w", 3)
    return f"""
  p0 AS (SELECT token, n, lower(token) AS w FROM {source}),
  p1 AS (SELECT token, n, CASE
           WHEN suffix(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
           WHEN suffix(w, 'sses') THEN {_cut('w', 2)} WHEN suffix(w, 'ss') THEN w
           WHEN suffix(w, 's') THEN {_cut('w', 1)} ELSE w END AS w FROM p0),
  p2 AS (SELECT token, n, w, CASE WHEN suffix(w, 'ied') OR suffix(w, 'eed') THEN 0
           WHEN suffix(w, 'ed') AND {_has_vowel(_cut('w', 2))} THEN 2
           WHEN suffix(w, 'ing') AND {_has_vowel(_cut('w', 3))} THEN 3 ELSE 0 END AS k FROM p1),
  p3 AS (SELECT token, n, w, k, left(w, length(w) - k) AS b FROM p2),
  p4 AS (SELECT token, n, CASE
           WHEN suffix(w, 'ied') THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
           WHEN suffix(w, 'eed') THEN CASE WHEN {_m0(_cut('w', 3))} THEN {_cut('w', 1)} ELSE w END
           WHEN k = 0 THEN w
           WHEN suffix(b, 'at') OR suffix(b, 'bl') OR suffix(b, 'iz') THEN b || 'e'
           WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND {_ends_consonant('b')}
             THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE {_cut('b', 1)} END
           WHEN {_m0('b')} AND NOT {_m1('b')} AND {_short_end('b')} THEN b || 'e' ELSE b END AS w FROM p3),
  p5 AS (SELECT token, n, CASE WHEN suffix(w, 'y') AND length(w) > 2 AND {_ends_consonant(_cut('w', 1))}
           THEN {_cut('w', 1)} || 'i' ELSE w END AS w FROM p4),
  p6 AS (SELECT token, n, CASE WHEN suffix(w, 'alli') AND {_m0(_cut('w', 4))} THEN {_cut('w', 2)} ELSE w END AS w FROM p5),
  p7 AS (SELECT token, n, {_rules(STEP2, lambda old, keep: _m0(logi if old == 'logi' else keep))} AS w FROM p6),
  p8 AS (SELECT token, n, {_rules(STEP3, lambda old, keep: _m0(keep))} AS w FROM p7),
  p9 AS (SELECT token, n, {_rules([(s, '') for s in STEP4], _step4_ok)} AS w FROM p8),
  p10 AS (SELECT token, n, CASE WHEN suffix(w, 'e') AND ({_m1(_cut('w', 1))} OR
           ({_m0(_cut('w', 1))} AND NOT {_short_end(_cut('w', 1))})) THEN {_cut('w', 1)} ELSE w END AS w FROM p9),
  p11 AS (SELECT token, n, CASE WHEN suffix(w, 'll') AND {_m1(_cut('w', 1))} THEN {_cut('w', 1)} ELSE w END AS w FROM p10),
  stemmed AS (SELECT token, n, CASE lower(token) {irregular}
                ELSE CASE WHEN length(token) < 3 THEN lower(token) ELSE w END END AS stem FROM p11)"""
