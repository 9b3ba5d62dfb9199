"""Detectors of personal data, prompt injection, credentials and sensitive names."""

from __future__ import annotations

import warnings
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Patterns, weights and levels that results depend on.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\+?\p{Nd}[\p{Nd}\s\p{Z}\-]{8,}\p{Nd}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b",
}
CARD = r"\b(?:\d[ -]*?){13,19}\b"
LEVELS = ["SAFE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
INJECTION = [
    ("direct_override", r"(?:ignore|disregard|forget|override|bypass|skip)\s+(?:all\s+)?(?:your\s+)?(?:previous|prior|earlier|above|preceding)\s+(?:instructions?|prompts?|rules?|guidelines?|constraints?|directives?)", 0.95, 4),
    ("direct_override_2", r"(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be|roleplay\s+as|from\s+now\s+on\s+you\s+(?:are|will|must|should))\s+(?:an?\s+)?(?:different|new|unrestricted|jailbroken|DAN|evil)", 0.95, 4),
    ("prompt_extraction", r"(?:output|print|show|reveal|display|repeat|echo)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?|rules?|initial\s+message|configuration|hidden\s+text)", 0.90, 3),
    ("prompt_extraction_2", r"(?:what\s+(?:are|is)\s+your|tell\s+me\s+your|copy\s+(?:and\s+)?(?:paste|output)\s+your)\s+(?:system\s+)?(?:prompt|instructions?|rules?)", 0.85, 3),
    ("safety_override", r"(?:disregard|ignore|override|bypass|disable|turn\s+off)\s+(?:your\s+)?(?:safety|ethical|moral|security|content\s+filter|alignment|guardrail|restriction|censor)", 0.90, 3),
    ("system_impersonation", r"(?:^|\n)\s*(?:SYSTEM|ADMIN|MODERATOR|ROOT|SUPERUSER|ASSISTANT|AI|BOT|INSTRUCTION|PROMPT)\s*[:\|]", 0.85, 3),
    ("system_impersonation_2", r"<\s*(?:system|admin|instruction|prompt)\s*>", 0.85, 3),
    ("base64_attempt", r"(?:decode|execute|run|interpret)\s+(?:this\s+)?base64\s*:?\s*[A-Za-z0-9+/]{20,}", 0.70, 2),
    ("hex_encoding", r"(?:decode|execute|run|interpret)\s+(?:this\s+)?hex\s*:?\s*[0-9a-fA-F]{20,}", 0.70, 2),
    ("cot_manipulation", r"(?:let\s+me\s+think|step\s+by\s+step|first\s+I'll|my\s+reasoning\s+is|therefore\s+I\s+(?:should|must|will))\s*(?:\.\s*)?(?:actually|but\s+wait|on\s+second|instead\s+I(?:'ll|\s+will)|let\s+me\s+(?:instead|also))", 0.50, 2),
    ("data_exfiltration", r"(?:send|transmit|upload|post|email|forward|exfiltrate)\s+(?:all\s+)?(?:the\s+)?(?:data|information|content|secrets?|keys?|tokens?|passwords?|credentials?|api[_\s]?keys?)(?:\s+(?:and|\&)\s+(?:all\s+)?(?:the\s+)?(?:data|information|content|secrets?|keys?|tokens?|passwords?|credentials?|api[_\s]?keys?))*\s+(?:to|at|via)\s+(?:https?|ftp|mailto|webhook|discord|slack)", 0.80, 3),
    ("leetspeak_decode", r"(?:h4ck|cr4ck|byp4ss|1gnore|d1sreg4rd|r3pl4ce|1ns3rt|3x3cut3|0verr1de)", 0.45, 2),
    ("new_instruction", r"(?:new\s+(?:instructions?|rules?|guidelines?|directives?)\s*:|updated\s+(?:instructions?|rules?|guidelines?)\s*:)", 0.40, 1),
    ("role_switch", r"(?:switch\s+to|enter|activate|enable)\s+(?:debug|admin|developer|sudo|root|unrestricted)\s+(?:mode|access|privilege|level)", 0.50, 2),
]
#: Words of which each rule needs one.
NEEDED = {
    "direct_override": ["previous", "prior", "earlier", "above", "preceding"],
    "direct_override_2": ["different", "new", "unrestricted", "jailbroken", "dan", "evil"],
    "prompt_extraction": ["prompt", "instruction", "rule", "initial", "configuration", "hidden"],
    "prompt_extraction_2": ["prompt", "instruction", "rule"],
    "safety_override": ["safety", "ethical", "moral", "security", "content", "alignment", "guardrail", "restriction", "censor"],
    "system_impersonation": ["system", "admin", "moderator", "root", "superuser", "assistant", "ai", "bot", "instruction", "prompt"],
    "system_impersonation_2": ["<"],
    "base64_attempt": ["base64"],
    "hex_encoding": ["hex"],
    "cot_manipulation": ["let", "step", "first", "reasoning", "therefore"],
    "data_exfiltration": ["http", "ftp", "mailto", "webhook", "discord", "slack"],
    "leetspeak_decode": ["h4ck", "cr4ck", "byp4ss", "1gnore", "d1sreg4rd", "r3pl4ce", "1ns3rt", "3x3cut3", "0verr1de"],
    "new_instruction": ["instruction", "rule", "guideline", "directive"],
    "role_switch": ["mode", "access", "privilege", "level"],
}
#: White space and letters beyond ASCII that the rules' white space and case folding mean as well, and what they are read as.
WHITE = "\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
FOLDED, FOLDED_TO = WHITE + "\u0130\u0131\u017f\u212a", " " * len(WHITE) + "iisk"
RTL = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufeff"
HOMOGLYPHS = "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0251\u03b5\u03bf"
COMMENT_WORDS = ["ignore", "instruction", "system", "prompt", "override", "execute", "inject"]
CODE_WORDS = ["ignore", "override", "system prompt", "jailbreak", "bypass"]
DETAILS_WORDS = ["ignore", "instruction", "system", "override", "execute"]
#: Families of secrets; the list is this engine's own.
CREDENTIALS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    "model_api_key": r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}",
    "payment_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "password": r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*[^\s'\x22]{6,}",
    "connection_string": r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/]+:[^\s@/]+@",
    "named_secret": r"(?i)(?:api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|secret|token)['\x22]?\s*[:=]\s*['\x22]?[A-Za-z0-9_./+=-]{16,}",
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}


def pii_values(c: Column, kind: str) -> Column:
    """All matches of one kind in order; ``credit_card`` are digit runs that pass the Luhn check."""
    if kind != "credit_card":
        return F.regexp_extract_all(c, F.lit(PII[kind]), F.lit(0))
    return F.filter(F.regexp_extract_all(c, F.lit(CARD), F.lit(0)), lambda v: luhn(v))


def luhn(c: Column) -> Column:
    """Whether the digits of a text, 13 to 19 of them, pass the Luhn check."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def pii_findings(c: Column) -> Column:
    """Array of (type, value), kind by kind."""

    def typed(kind: str) -> Column:
        return F.transform(pii_values(c, kind), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return F.concat(*[typed(k) for k in [*PII, "credit_card"]])


SPANS = ArrayType(StructType().add("type", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("value", StringType()))


@F.pandas_udf(SPANS)
def pii_spans(s: pd.Series) -> pd.Series:
    """Findings with their places, which SQL functions don't give for every match."""
    import re

    rules = [(k, re.compile(p.replace(r"\p{Nd}", r"\d").replace(r"\p{Z}", ""))) for k, p in PII.items()]
    card = re.compile(CARD)

    def valid(raw: str) -> bool:
        d = [int(x) for x in raw if x.isdigit()]
        if not 13 <= len(d) <= 19:
            return False
        return sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(reversed(d))) % 10 == 0

    def find(t: str | None) -> list[dict]:
        out = [{"type": k, "start": m.start(), "end": m.end(), "value": m.group()} for k, p in rules for m in p.finditer(t or "")]
        return out + [{"type": "credit_card", "start": m.start(), "end": m.end(), "value": m.group()} for m in card.finditer(t or "") if valid(m.group())]

    return s.map(find)


def _among(chars: str) -> str:
    """A class of characters; texts are searched for it before anything slower looks at them."""
    return "[" + "".join(f"\\x{{{ord(x):x}}}" for x in chars) + "]"


def _count_of(c: Column, chars: str) -> Column:
    return F.when(c.rlike(_among(chars)), F.length(c) - F.length(F.translate(c, chars, ""))).otherwise(0)


def _any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def injection_risk(c: Column) -> Column:
    """Struct (risk, score, patterns): the highest level and weight of all rules that match, with their names in order."""
    none = F.lit(None).cast("struct<name:string,weight:double,level:int>")
    rule = lambda name, weight, level: F.struct(name.alias("name"), weight.alias("weight"), level.alias("level"))
    # the words that each rule cannot match without are looked for first, in the lower-cased text
    plain = F.when(c.rlike(_among(FOLDED)), F.translate(c, FOLDED, FOLDED_TO)).otherwise(c)

    def matched(said: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_any_of(said["low"], NEEDED[n]) & said["plain"].rlike("(?i)" + p), rule(F.lit(n), F.lit(w), F.lit(lv))).otherwise(none) for n, p, w, lv in INJECTION]))

    # both forms of the text are bound, so that each is made once for all rules
    found = F.transform(F.transform(F.array(plain), lambda x: F.struct(x.alias("plain"), F.lower(x).alias("low"))), matched)[0]
    zero, homo = _count_of(c, ZERO_WIDTH), _count_of(c, HOMOGLYPHS)
    tags = F.when(c.rlike("[\ue000-\ue07f]"), F.length(c) - F.length(F.regexp_replace(c, "[\ue000-\ue07f]", ""))).otherwise(0)
    odd = [
        F.when(_count_of(c, RTL) > 0, F.lit("unicode_rtl_override")),
        F.when(zero > 3, F.concat(F.lit("unicode_zero_width("), zero.cast("string"), F.lit(")"))),
        F.when(homo > 2, F.concat(F.lit("unicode_homoglyphs("), homo.cast("string"), F.lit(")"))),
        F.when(tags > 0, F.concat(F.lit("unicode_tag_chars("), tags.cast("string"), F.lit(")"))),
    ]
    odd = F.array_compact(F.array(*odd))
    weight = F.round(0.6 + 0.15 * F.size(odd), 10)
    odd_rules = F.transform(odd, lambda n: rule(n, F.least(F.lit(1.0), weight), F.when(F.size(odd) >= 2, 3).otherwise(2)))
    comments = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<!--\s*(.*?)\s*-->"), F.lit(1)), F.lower), lambda x: _any_of(x, COMMENT_WORDS))
    blocks = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```.*?```"), F.lit(0)), F.lower), lambda x: _any_of(x, CODE_WORDS))
    details = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<details[^>]*>(.*?)</details>"), F.lit(1)), F.lower), lambda x: _any_of(x, DETAILS_WORDS))
    marks = F.concat(
        F.transform(comments, lambda x: F.concat(F.lit("html_comment_injection: "), F.substring(x, 1, 50))),
        F.transform(blocks, lambda x: F.lit("code_block_suspicious")),
        F.transform(details, lambda x: F.lit("hidden_details_injection")),
    )
    every = F.concat(found, odd_rules, F.transform(marks, lambda n: rule(n, F.lit(0.65), F.lit(3))))
    names = F.array(*[F.lit(x) for x in LEVELS])

    def summed(rules: Column) -> Column:
        level = F.coalesce(F.array_max(F.transform(rules, lambda r: r["level"])), F.lit(0))
        return F.struct(F.element_at(names, level + 1).alias("risk"), F.coalesce(F.array_max(F.transform(rules, lambda r: r["weight"])), F.lit(0.0)).alias("score"), F.transform(rules, lambda r: r["name"]).alias("patterns"))

    return F.transform(F.array(every), summed)[0]  # binds the rules, so that they run once


RECOMMENDATION = {
    "SAFE": "no injection found; use as is",
    "LOW": "weak signs; use with attention",
    "MEDIUM": "suspicious; show to the model as quoted data only",
    "HIGH": "likely injection; review before use",
    "CRITICAL": "injection; do not pass to a model",
}


def recommendation(risk: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RECOMMENDATION.items() for x in kv])[risk]


def trust_of(c: Column) -> Column:
    """The trust struct of an entry."""
    r = injection_risk(c)
    return F.struct(r["risk"].alias("risk"), r["score"].alias("score"), r["patterns"].alias("patterns"), recommendation(r["risk"]).alias("recommendation"))


def wrap_untrusted(c: Column, label: str = "untrusted") -> Column:
    return F.concat(F.lit(f"<{label}>\n"), c, F.lit(f"\n</{label}>"))


def sanitize_untrusted(c: Column) -> Column:
    """SAFE and LOW pass; MEDIUM is wrapped; above it, matches of HIGH rules and up become ``[REMOVED]`` first."""
    risk = injection_risk(c)["risk"]
    removed = reduce(lambda t, r: F.regexp_replace(t, "(?iU)" + r[1], "[REMOVED]"), [r for r in INJECTION if r[3] >= 3], c)
    return F.when(risk.isin("SAFE", "LOW"), c).when(risk == "MEDIUM", wrap_untrusted(c)).otherwise(wrap_untrusted(removed))


def credentials(c: Column) -> Column:
    """Names of the families of secrets that a text holds."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in CREDENTIALS.items()]))


def sensitive_name(c: Column) -> Column:
    """A name that looks like an address or a phone number."""
    return F.contains(c, F.lit("@")) | c.rlike(r"\+?\d[\d\s\-]{8,}\d")


def redact(c: Column, secrets: list[str]) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("[REDACTED]")), [s for s in secrets if s], c)


def scan_pii(entries: DataFrame, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """One row a finding, with the entry's cartridge and key; deleted entries are scanned too."""
    text = F.concat_ws("\n", *[F.col(c) for c in columns])
    return entries.select("cartridge", "key", F.explode(pii_findings(text)).alias("f")).select("cartridge", "key", "f.type", "f.value")


def valid_policy(value_bytes: Column, auth: Column, host: Column, url: Column) -> Column:
    """A secret's use policy: at most 64 KB, a known way of authentication, one exact host over HTTPS."""
    url_host = F.regexp_extract(url, r"^https://([^/?#:]+)", 1)
    return (value_bytes <= 64 * 1024) & auth.rlike(r"^(?:bearer|header:.+|query:.+)$") & ~F.contains(host, F.lit("*")) & (url_host != "") & (url_host == host)


def warn_if_pii(rows: DataFrame, column: str = "content", context: str = "memory") -> list[str]:
    """The kinds of personal data that a column's texts hold, with a warning if there are any; nothing is kept back."""
    found = rows.select(F.explode(pii_findings(F.col(column))).alias("f")).select("f.type").distinct().orderBy("type")
    kinds = [r["type"] for r in found.collect()]  # as many as there are rules
    if kinds:
        warnings.warn(f"content in {context} looks like PII: {kinds}", stacklevel=2)
    return kinds
