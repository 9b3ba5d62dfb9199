"""Numbers: decay utility, cache footprints, quantiles by rank, arithmetic answers."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Weights of the decay model, model geometry, bytes of a number.
DECAY_PER_HOUR, ACCESS_WEIGHT, DEMOTE_BELOW, KEEP_RATIO, BUDGET = 0.10, 0.15, 0.10, 0.80, 25_000
PRECISION_BYTES = {"fp16": 2, "bf16": 2, "fp32": 4, "int8": 1, "fp8": 1}
MODELS = [
    ("llama-3.1-8b", 32, 8, 128),
    ("llama-3.1-70b", 80, 8, 128),
    ("llama-3.1-405b", 126, 8, 128),
    ("llama-3-1b", 16, 8, 64),
    ("qwen2.5-7b", 28, 4, 128),
    ("qwen2.5-32b", 64, 8, 128),
    ("mistral-7b", 32, 8, 128),
    ("mixtral-8x7b", 32, 8, 128),
]


def utility(salience: Column, age_hours: Column, accesses: Column, weight: float = 1.0, decay: float = DECAY_PER_HOUR, per_access: float = ACCESS_WEIGHT) -> Column:
    """Salience that decays by the hour plus a bonus for each access; negative ages count as 0."""
    return weight * salience * F.exp(-decay * F.greatest(age_hours, F.lit(0.0))) + per_access * accesses


def kv_estimates(spark: SparkSession, bucket_tokens: int = 1_000_000, budgets: tuple[int, ...] = (1, 3, 10), tokens_each: int = 45, precision: str = "fp16") -> DataFrame:
    """Cache bytes of a whole context against recalled exchanges, for each model and recall budget."""
    if precision not in PRECISION_BYTES:
        raise ValueError(f"unknown precision {precision!r}; use {sorted(PRECISION_BYTES)}")
    models = spark.createDataFrame(MODELS, "model string, layers int, kv_heads int, head_dim int")
    rows = models.withColumn("k", F.explode(F.array(*[F.lit(b) for b in budgets])))
    per = F.col("layers").cast("bigint") * F.col("kv_heads") * 2 * F.col("head_dim") * PRECISION_BYTES[precision]
    sparse = F.col("k").cast("bigint") * tokens_each
    full, part = per * bucket_tokens, per * sparse
    return rows.select(
        "model", "k", per.alias("kv_bytes_per_token"), full.alias("stuffing_kv_bytes"), sparse.alias("sparse_tokens"), part.alias("sparse_kv_bytes"),
        F.when(part != 0, full / part).otherwise(F.lit(float("inf"))).alias("reduction_x"),
        F.when(full != 0, (F.lit(1.0) - part / full) * 100).otherwise(F.lit(0.0)).alias("savings_pct"),
    )


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluate(text: str | None) -> float | None:
    """The value of the arithmetic on the last line, with or without ``ANSWER=``; None if it is anything else."""
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    if not lines:
        return None
    line = lines[-1]
    line = line[7:] if line.upper().startswith("ANSWER=") else line
    for a in ("x", "X", "×"):
        line = line.replace(a, "*")

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        raise ValueError(node)

    try:
        return float(value(ast.parse(line.strip(), mode="eval").body))
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None


@F.pandas_udf(DoubleType())
def evaluated(s: pd.Series) -> pd.Series:
    return s.map(evaluate).astype("float64")
