"""Text functions of the memory model: normalising, sanitising, distilling, slugs, references."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import MAX_CONTENT, MAX_KEY, TRUNCATED

# Word lists, marker patterns and limits that results depend on.
STOP_SESSION = (
    "the a an is are was were be been being have has had do does did will would could should can may might to of in for on with "
    "at by from as into about and or but not if then else when what which who how why that this these those it its we our you "
    "your i me my there here ok okay please just also so up out again still lets let"
).split()
STOP_FACT = (
    "the a an is are was were be been being to of in for on with at by from as into about that this and or but we our you your "
    "i me it its what how do does can could"
).split()
STOP_EN = (
    "a an the and or but if then else for in on at to of by with from as is are was were be been being it its this that these those "
    "i you he she we they me him her us them my your his its our their what which who whom when where how why can could should would "
    "may might must will shall not no do does did"
).split()
AFFIX_EN = ["ing", "ed", "es", "s", "ly"]
DEIXIS = "that this it its they them their those these earlier before previous previously above mentioned referenced same said aforementioned last prior".split()
SALIENT = (
    r"(?i)\b(\d+(?:\.\d+)?\s*(?:ms|s|kb|mb|gb|%|percent)|error|fail(?:ed|ure|ing)?|bug|crash|timeout|root\s*cause|decided|decision|"
    r"agreed|deferred|todo|blocked|deadline|never|always|must)\b"
)
EDGE_MARKS = ".,;:!?()[]{}'\""
#: White space of any kind, as a class for Java's patterns.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LANGUAGE_OF = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby",
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".swift": "swift", ".kt": "kotlin",
}


def _words(*names: str) -> Column:
    return F.array(*[F.lit(w) for w in names])


def strip(c: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def normalize(c: Column) -> Column:
    """Lower case, punctuation to spaces, runs of white space to one, trimmed: the form of exact keys."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def sanitize_content(c: Column) -> Column:
    """No control characters, trimmed, at most 50,000 characters and a mark."""
    clean = strip(F.regexp_replace(c, CONTROL, ""))
    return F.when(F.length(clean) > MAX_CONTENT, F.concat(F.substring(clean, 1, MAX_CONTENT), F.lit(TRUNCATED))).otherwise(clean)


def sanitize_key(c: Column) -> Column:
    return F.substring(strip(F.regexp_replace(c, CONTROL, "")), 1, MAX_KEY)


def tokens(c: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def drop_words(c: Column, words: list[str]) -> Column:
    listed = _words(*words)
    return F.array_join(F.filter(tokens(c), lambda w: ~F.array_contains(listed, F.lower(w))), " ")


def strip_affixes(c: Column, affixes: list[str], min_stem: int = 3) -> Column:
    """Lower-case tokens without their first matching suffix, the longest tried first."""
    by_length = sorted(dict.fromkeys(affixes), key=len, reverse=True)

    def cut(w: Column) -> Column:
        w = F.lower(w)
        return reduce(lambda rest, a: F.when(w.endswith(a) & (F.length(w) - len(a) >= min_stem), w.substr(F.lit(1), F.length(w) - len(a))).otherwise(rest), reversed(by_length), w)

    return F.array_join(F.transform(tokens(c), cut), " ")


@F.pandas_udf(StringType())
def unicode_fold(s: pd.Series) -> pd.Series:
    """NFKD without combining marks (no built-in expression decomposes text)."""

    def fold(t: str | None) -> str | None:
        return t if t is None or t.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))

    return s.map(fold)


def normalizer(steps: str, words: dict[str, list[str]] | None = None):
    """A Column builder from a comma list of steps: ``unicode_fold``, ``stopwords:en``, ``affix:en``, or ``stopwords:NAME`` and ``affix:NAME`` of ``words``.

    An unknown step raises ValueError.
    """
    known = words or {}
    chain = []
    for step in filter(None, (s.strip() for s in steps.split(","))):
        name, _, arg = step.partition(":")
        if step == "unicode_fold":
            chain.append(unicode_fold)
        elif name == "stopwords" and (arg == "en" or arg in known):
            chain.append(lambda c, w=known.get(arg, STOP_EN): drop_words(c, w))
        elif name == "affix" and (arg == "en" or arg in known):
            chain.append(lambda c, w=known.get(arg, AFFIX_EN): strip_affixes(c, w))
        else:
            raise ValueError(f"unknown normalizer step: {step!r}")
    return lambda c: reduce(lambda x, f: f(x), chain, c)


def _bare_words(c: Column) -> Column:
    return F.transform(tokens(c), lambda w: F.lower(F.btrim(w, F.lit(EDGE_MARKS))))


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more, in order, without stop words and deixis."""
    listed = _words(*STOP_SESSION, *DEIXIS)
    return F.array_distinct(F.filter(_bare_words(c), lambda w: (F.length(w) > 2) & ~F.array_contains(listed, w)))


def drop_deixis(c: Column, anchors: Column) -> Column:
    """Words without deixis; with fewer than two words of content left, the first three anchors follow."""

    def joined(kept: Column) -> Column:
        clean = F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))
        full = F.size(F.filter(kept, lambda w: ~F.array_contains(_words(*STOP_SESSION), w))) >= 2
        return F.when(full, clean).otherwise(F.trim(F.concat_ws(" ", clean, F.array_join(F.slice(anchors, 1, 3), " "))))

    return _with(F.filter(_bare_words(c), lambda w: ~F.array_contains(_words(*DEIXIS), w)), joined)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value bound, so that it is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _anchors(question_words: Column, answer_words: Column) -> Column:
    return F.array_distinct(F.concat(F.slice(question_words, 1, 4), F.slice(answer_words, 1, 10)))


def anchors_of(question: Column, answer: Column) -> Column:
    return F.slice(_anchors(content_words(question), content_words(answer)), 1, 12)


def distilled_keys(question: Column, answer: Column) -> Column:
    """Up to three lookup keys of an exchange; a key that equals a single anchor is dropped."""

    def keys(words: Column) -> Column:
        every, a = words["every"], words["a"]
        anchors = F.slice(every, 1, 12)
        made = F.array(drop_deixis(question, anchors), F.array_join(F.slice(anchors, 1, 8), " "), F.when(F.size(a) >= 3, F.array_join(F.slice(a, 1, 6), " ")).otherwise(F.lit("")))
        return F.array_distinct(F.filter(made, lambda k: (F.trim(k) != "") & ~F.array_contains(every, k)))

    both = F.struct(content_words(question).alias("q"), content_words(answer).alias("a"))
    return _with(_with(both, lambda w: F.struct(_anchors(w["q"], w["a"]).alias("every"), w["a"].alias("a"))), keys)


def salience(c: Column) -> Column:
    """Markers, questions and length as a number up to 1, to three digits."""
    marks = F.size(F.regexp_extract_all(c, F.lit(SALIENT), F.lit(0)))
    asked = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return F.round(F.least(F.lit(1.0), 0.3 * marks + 0.2 * asked + F.least(F.lit(0.4), 0.01 * F.size(tokens(c)))), 3)


def fact_body(c: Column) -> Column:
    return F.regexp_replace(c, r"^\[turns[^\]]*\]\s*", "")


def fact_key(body: Column, xid: Column, prefix: str = "fact:") -> Column:
    listed = _words(*STOP_FACT)
    first = F.lower(F.array_join(F.slice(F.filter(tokens(body), lambda w: ~F.array_contains(listed, F.lower(w))), 1, 5), " "))
    return F.concat(F.lit(prefix), F.when(first == "", F.concat(F.lit("exchange-"), xid.cast("string"))).otherwise(first), F.lit(" "), xid.cast("string"))


def slug(c: Column) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""), 1, 42)
    return F.when(s == "", "untitled").otherwise(s)


def skill_badge(name: Column, content: Column) -> Column:
    badge = F.concat(F.lit("SKILL "), name, F.lit(": "))
    return F.when(content.startswith("SKILL "), content).otherwise(F.concat(badge, content))


def vault_ref(c: Column) -> tuple[Column, Column]:
    """(vault, name) of ``vault:[V/]N``, ``vault://[V/]N`` and ``${vault:[V/]N}``; nulls if it is none of these."""
    inner = F.regexp_extract(F.trim(c), r"^(?:\$\{vault:([^}]+)\}|vault:(?://)?(.+))$", 1)
    plain = F.regexp_extract(F.trim(c), r"^(?:\$\{vault:([^}]+)\}|vault:(?://)?(.+))$", 2)
    ref = F.when(inner != "", inner).otherwise(plain)
    has = F.contains(ref, F.lit("/"))
    vault = F.when(ref == "", None).when(has, F.substring_index(ref, "/", 1)).otherwise("default")
    return vault, F.when(ref == "", None).when(has, F.regexp_replace(ref, r"^[^/]*/", "")).otherwise(ref)


def language_of(path: Column) -> Column:
    """Programming language by file extension, or null."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[ext]


def digest16(*cols: Column) -> Column:
    """First 16 hex digits of SHA-256 over the columns joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16)
