"""Kinds, constants and schemas of the data model."""

from __future__ import annotations

# Kind numbers are part of the stored format.
KINDS = {"generic": 0, "fact": 1, "skill": 2, "doc": 3, "turn": 4}
KIND_NAMES = {v: k for k, v in KINDS.items()}

DIMS = 1024
WORDS = DIMS // 64
NGRAM = 3
SEED = "recallforge-v1"

FUZZY_THRESHOLD = 0.60
SEMANTIC_THRESHOLD = 0.60
MIN_CONFIDENCE = 0.75
RECALL_POOL = 40
MAX_ENTRIES = 25_000
SHARD_SEP = "__"
MAX_CONTENT = 50_000
MAX_KEY = 1024
TRUNCATED = "... [truncated]"

ENTRIES = (
    "entry_id bigint, cartridge string, content string, key string, key_norm string, kind tinyint, source string, meta map<string,string>, "
    "trust struct<risk:string,score:double,patterns:array<string>,recommendation:string>, deleted boolean, k array<bigint>, c array<bigint>, sk array<bigint>, sc array<bigint>"
)


def kind_number(kind: str | int | None) -> int:
    """A kind's number; unknown names and null are generic, numbers pass."""
    if kind is None:
        return 0
    return kind if isinstance(kind, int) else KINDS.get(kind, 0)
