"""Pieces of DuckDB SQL that restate functions of this engine."""

from __future__ import annotations

from ..functions import detectors, text
from ..schema import SEED


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(words: list[str]) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def normalize(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


#: White space of any kind, as a class for DuckDB's patterns.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{BLANK}+'), lambda w: w <> '')"


def bare(c: str) -> str:
    return f"list_transform({tokens(c)}, lambda w: lower(trim(w, {quote(text.EDGE_MARKS)})))"


def distinct(c: str) -> str:
    """Distinct elements in order of first place."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def content_words(c: str) -> str:
    return f"list_filter({bare(c)}, lambda w: length(w) > 2 AND NOT list_contains({strings(text.STOP_SESSION + text.DEIXIS)}, w))"


def encode(source: str, name: str = "enc", seed: str = SEED) -> str:
    """CTEs that end in ``name(t, bits, hex)`` for the distinct texts of ``source(t)``."""
    plane = lambda b: f"sum(c * (((strpos('0123456789abcdef', substr(h, pos, 1)) - 1) >> {b}) & 1))"
    return f"""
{name}_p AS (SELECT DISTINCT t, '  ' || lower({strip('t')}) || '  ' AS p FROM {source}),
{name}_g AS (SELECT t, substr(p, i, 3) AS g, count(*) AS c FROM (SELECT t, p, unnest(range(1, length(p) - 1)) AS i FROM {name}_p) GROUP BY ALL),
{name}_a AS (SELECT g, sha256('{seed}:' || g || ':0') || sha256('{seed}:' || g || ':1') || sha256('{seed}:' || g || ':2') || sha256('{seed}:' || g || ':3') AS h FROM (SELECT DISTINCT g FROM {name}_g)),
{name}_s AS (SELECT t, pos, sum(c) AS n, {plane(3)} AS b3, {plane(2)} AS b2, {plane(1)} AS b1, {plane(0)} AS b0
  FROM {name}_g JOIN {name}_a USING (g), range(1, 257) r(pos) GROUP BY t, pos),
{name} AS (SELECT t,
  string_agg((2 * b3 > n)::INT::VARCHAR || (2 * b2 > n)::INT::VARCHAR || (2 * b1 > n)::INT::VARCHAR || (2 * b0 > n)::INT::VARCHAR, '' ORDER BY pos)::BIT AS bits,
  string_agg(substr('0123456789abcdef', (2 * b3 > n)::INT * 8 + (2 * b2 > n)::INT * 4 + (2 * b1 > n)::INT * 2 + (2 * b0 > n)::INT + 1, 1), '' ORDER BY pos) AS hex
  FROM {name}_s GROUP BY t)"""


def sim(a: str, b: str) -> str:
    return f"(1.0 - bit_count(xor({a}, {b}))::DOUBLE / 1024)::DOUBLE"


def luhn(c: str) -> str:
    d = rf"regexp_replace({c}, '\D', '', 'g')"
    digit = f"substr({d}, length({d}) - i, 1)::INT"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"


def injection(c: str) -> str:
    """A struct (risk level number, score, pattern count) of a text."""
    plain = f"translate({c}, {quote(detectors.FOLDED)}, {quote(detectors.FOLDED_TO)})"
    rules = [f"CASE WHEN regexp_matches({plain}, {quote('(?i)' + p)}) THEN {{'w': {w}::DOUBLE, 'l': {lv}}} END" for _, p, w, lv in detectors.INJECTION]
    count = lambda chars: f"(length({c}) - length(translate({c}, {quote(chars)}, '')))"
    tags = rf"(length({c}) - length(regexp_replace({c}, '[\x{{e000}}-\x{{e07f}}]', '', 'g')))"
    odd = f"(({count(detectors.RTL)} > 0)::INT + ({count(detectors.ZERO_WIDTH)} > 3)::INT + ({count(detectors.HOMOGLYPHS)} > 2)::INT + ({tags} > 0)::INT)"
    odd_rules = f"list_transform(range(0, {odd}), lambda i: {{'w': least(1.0, round(0.6 + 0.15 * {odd}, 10))::DOUBLE, 'l': CASE WHEN {odd} >= 2 THEN 3 ELSE 2 END}})"
    has = lambda words: " OR ".join(f"contains(lower(x), {quote(w)})" for w in words)
    marks = " + ".join(
        f"len(list_filter(regexp_extract_all({c}, {quote(p)}, {g}), lambda x: {has(words)}))"
        for p, g, words in ((r"(?s)<!--\s*(.*?)\s*-->", 1, detectors.COMMENT_WORDS), ("(?s)```.*?```", 0, detectors.CODE_WORDS), (r"(?is)<details[^>]*>(.*?)</details>", 1, detectors.DETAILS_WORDS))
    )
    mark_rules = f"list_transform(range(0, {marks}), lambda i: {{'w': 0.65::DOUBLE, 'l': 3}})"
    return f"list_concat(list_concat(list_filter([{', '.join(rules)}], lambda r: r IS NOT NULL), {odd_rules}), {mark_rules})"
