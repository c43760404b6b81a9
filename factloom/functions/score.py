"""The four-factor score: similarity, confidence, recency, utility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.temporal import hours_between, valid_at

# Forgetting per hour of a memory type, and of all others.
DECAY = {"episodic": 0.08, "semantic": 0.02, "procedural": 0.001, "working": 999.0}
DECAY_ELSE = 0.05


@dataclass(frozen=True)
class Weights:
    similarity: float = 0.40
    confidence: float = 0.30
    recency: float = 0.20
    utility: float = 0.10
    decay: float = 0.05

    def shares(self) -> tuple[float, float, float, float]:
        all_ = self.similarity + self.confidence + self.recency + self.utility
        if not all_:
            return Weights().shares()
        return self.similarity / all_, self.confidence / all_, self.recency / all_, self.utility / all_


@dataclass(frozen=True)
class Mode:
    weights: Weights
    admit: float
    depth: int


# Presets of a namespace's mode.
MODES = {
    "belief": Mode(Weights(0.30, 0.45, 0.20, 0.05, 0.03), 0.15, 4),
    "agent": Mode(Weights(0.35, 0.20, 0.25, 0.20, 0.05), 0.35, 2),
    "general": Mode(Weights(), 0.25, 3),
    "procedural": Mode(Weights(0.40, 0.40, 0.15, 0.05, 0.001), 0.40, 3),
}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def decay_alpha(mem_type: Column) -> Column:
    out = F.lit(DECAY_ELSE)
    for k, v in DECAY.items():
        out = F.when(mem_type == k, v).otherwise(out)
    return out


def neutral(confidence: Column) -> Column:
    """Null and 0 say nothing: 0.5."""
    return F.when(confidence.isNull() | (confidence == 0), 0.5).otherwise(confidence)


def node_utility(u: Column) -> Column:
    return F.coalesce(clamp(u), F.lit(1.0))


def session_factor(most_similar: Column) -> Column:
    """What is left of the similarity of a node that resembles the session: 1 up to 0.8, down to 0.5 at 1."""
    return F.when(most_similar > 0.8, F.greatest(F.lit(0.5), 1 - (most_similar - 0.8) * 2.5)).otherwise(1.0)


def score(similarity: Column, t: Column, w: Weights, depth: Column | None = None, decay_per_hop: float = 0.9, decay: Column | None = None) -> Column:
    """Struct score, similarity_score, confidence_score, recency_score, utility_score, breakdown of a row with
    valid_from, valid_until, confidence and utility; score 0 where it isn't valid at t."""
    alpha = F.lit(w.decay) if decay is None else decay
    recency = clamp(F.exp(-alpha * F.greatest(F.lit(0.0), hours_between(F.col("valid_from"), t))))
    conf = neutral(F.col("confidence"))
    if depth is not None:
        conf = conf * F.when(depth > 0, F.pow(F.lit(decay_per_hop), depth)).otherwise(1.0)
    left = hours_between(t, F.col("valid_until"))
    conf = clamp(conf * F.when(left > 0, 1 - F.exp(-0.02 * left)).otherwise(1.0))
    sim, use = clamp(similarity), node_utility(F.col("utility"))
    s, c, r, u = w.shares()
    total = s * sim + c * conf + r * recency + u * use
    ok = F.coalesce(valid_at(t), F.lit(False))
    return F.struct(
        F.when(ok, total).otherwise(0.0).alias("score"), sim.alias("similarity_score"), conf.alias("confidence_score"), recency.alias("recency_score"), use.alias("utility_score"),
        F.struct((s * sim).alias("similarity"), (c * conf).alias("confidence"), (r * recency).alias("recency"), (u * use).alias("utility")).alias("breakdown"),
    )
