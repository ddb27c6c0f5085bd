"""All tunables of search, chunking and ranking in frozen configuration objects."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RankConfig:
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 10
    max_df_ratio: float = 0.6
    seed_terms: int = 2
    other_language_penalty: float = 0.9
    title_boost: int = 3
    title_weight: float = 0.15
    proximity_weight: float = 0.10
    freshness_weight: float = 0.08
    fresh_days: float = 14.0
    max_per_domain: int = 2
    min_tokens: int = 20
    min_unique_ratio: float = 0.2
    strict_language: bool = False
    # Parts of addresses that no result may have.
    excluded_urls: tuple[str, ...] = ("/privacy", "/gizlilik", "/kvkk", "/terms", "/cookies", "/login", "/register", "/signup", "/cart", "/account", "/checkout", "/404", "/error", "/rss")
    snippet_radius: int = 120

    @property
    def initial_k(self) -> int:
        return max(50, self.top_k * 4)


@dataclass(frozen=True)
class FuzzyConfig:
    k: int = 3
    jaccard_min: float = 0.2
    shortlist: int = 200
    cutoff: float = 0.72
    ratio_weight: float = 0.7


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 160
    overlap: int = 30


@dataclass(frozen=True)
class GraphConfig:
    damping: float = 0.85
    epsilon: float = 1e-5
    max_iterations: int = 100
