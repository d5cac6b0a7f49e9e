"""Typed settings with defaults and clamps, from the environment or a mapping."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Normalisation scales and the risk assumed for an unknown merchant category.
DEFAULT_SCALES = {
    "max_amount": 10000.0,
    "max_installments": 12.0,
    "amount_vs_avg_ratio": 10.0,
    "max_minutes": 1440.0,
    "max_km": 1000.0,
    "max_tx_count_24h": 20.0,
    "max_merchant_avg_amount": 10000.0,
}
DEFAULT_RISK = 0.5
GRID = 10000
FEATURES = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last", "km_from_last",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    threshold: float = 0.6
    n_centroids: int = 1024
    n_probe: int = 2
    max_cluster: int = 512
    kmeans_iters: int = 18
    kmeans_sample: int = 131_072
    split_iters: int = 10
    seed: int = 42
    metric: str = "EUCLIDEAN"
    index: str = "IVF"
    exact_repair: bool = True
    early_stop: bool = False
    dev_fallback: bool = False
    timings: bool = False
    query_block: int = 4096
    scales: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_SCALES))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Blank or malformed values fall back to the default; counts are held at 1 or more."""
        env = os.environ if env is None else env
        d = cls()

        def num(key, kind, default, least=None):
            try:
                v = kind(env.get(key, "").strip())
            except ValueError:
                return default
            return v if least is None else max(least, v)

        def flag(key, default):
            raw = env.get(key, "").strip().lower()
            return raw in ("1", "true", "yes", "on") if raw else default

        return cls(
            top_k=num("TOP_K", int, d.top_k, 1), threshold=num("THRESHOLD", float, d.threshold), n_centroids=num("IVF_CENTROIDS", int, d.n_centroids, 1),
            n_probe=num("IVF_NPROBE", int, d.n_probe, 1), max_cluster=num("IVF_MAX_CLUSTER", int, d.max_cluster, 1), seed=num("SEED", int, d.seed),
            metric=env.get("DISTANCE_METRIC", "").strip() or d.metric, index=env.get("VECTOR_INDEX", "").strip() or d.index,
            exact_repair=flag("EXACT_REPAIR", d.exact_repair), early_stop=flag("EARLY_STOP", d.early_stop), dev_fallback=flag("DEV_FALLBACK", d.dev_fallback),
            timings=flag("PERF_LOG", d.timings),
        )
