"""The data model: tiers, entry types and their files, weights, thresholds, the document table."""

from __future__ import annotations

from pyspark.sql import types as T

#: The file of each entry type, by tier; the first type of a tier takes unknown ones.
TIERS = {
    "episodic": {"experience": "experiences", "decision": "decisions", "failure": "failures"},
    "semantic": {"fact": "facts", "relation": "relations"},
    "procedural": {"skill": "skills", "pattern": "patterns"},
}
#: Initial weight by entry type.
INITIAL_WEIGHTS = {
    "user_teaching": 2.0,
    "user_correction": 1.8,
    "self_correction": 1.5,
    "achievement": 1.3,
    "decision": 1.2,
    "failure": 1.0,
    "observation": 0.8,
    "fact": 1.0,
    "skill": 1.2,
    "pattern": 1.0,
}
#: Bounds of a weight, daily and neutral decay, factors and strict bounds of reinforcement.
WEIGHT_LOW, WEIGHT_HIGH = 0.1, 5.0
DECAY, BOOST, PENALTY = 0.995, 1.1, 0.9
GOOD, BAD = 0.7, 0.3
#: Scores from which an overview or a full text is loaded, the flat charge and number of overviews.
L1_SCORE, L2_SCORE, L1_CHARGE, L1_SLOTS = 0.4, 0.7, 2000, 3
#: Characters given to a summariser, by level, the tokens that an overview may have, and the fewest words of an abstract.
L0_INPUT, L1_INPUT, L1_OUTPUT, L0_WORDS = 12000, 16000, 3000, 10
#: Fixed values.
DOC_TYPES = ("strategy", "backtest", "research", "episode", "skill", "pattern", "session_learning", "reference")
#: Bounds and defaults of requests.
LIMIT, BUDGET, TOP_K = (1, 100, 10), (100, 50000, 4000), (1, 50, 10)

_S, _L = T.StringType(), T.ArrayType(T.StringType())
DOCUMENT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("doc_id", _S), ("hierarchy_path", _S), ("title", _S), ("doc_type", _S), ("l0_abstract", _S), ("l0_token_count", T.IntegerType()), ("l1_overview", _S), ("l1_token_count", T.IntegerType()),
            ("l2_file_path", _S), ("l2_token_count", T.IntegerType()), ("l2_checksum", _S), ("parent_path", _S), ("depth", T.IntegerType()), ("tags", _L), ("created_at", _S), ("updated_at", _S),
            ("is_stale", T.BooleanType()), ("stale_reason", _S), ("source_type", _S), ("cortex_tier", _S), ("seq", T.LongType()),
        )
    ]
)


def check_tiers(tiers: list[str] | None) -> list[str]:
    """The tiers asked for, each once in the order given; none or an empty list: all. Unknown ones are an error."""
    chosen = list(dict.fromkeys(tiers or TIERS))
    if unknown := [t for t in chosen if t not in TIERS]:
        raise ValueError(f"unknown tier: {', '.join(unknown)}")
    return chosen


def within(name: str, value: float, bounds: tuple) -> float:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must lie between {bounds[0]} and {bounds[1]}")
    return value
