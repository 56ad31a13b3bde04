"""Cost modes: how large chunks, retrieval legs and budgets are."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CostMode:
    name: str
    chunk_target_tokens: int
    chunk_max_tokens: int
    chunk_overlap_tokens: int
    final_limit: int
    leg_limit: int
    context_token_budget: int
    candidate_token_budget: int


# Fixed values.
MODES = {
    "low": CostMode("low", 950, 1300, 40, 6, 32, 4500, 8000),
    "balanced": CostMode("balanced", 650, 950, 120, 12, 80, 10000, 22000),
    "quality": CostMode("quality", 520, 780, 180, 16, 120, 14000, 32000),
}
EMBEDDING_BATCH = 64
DAILY_TOKEN_LIMIT = 100_000
MEMORY_MESSAGES = 12
PRICE_PER_1K_TOKENS = 0.00013
CACHE_TTL_SECONDS = 900
