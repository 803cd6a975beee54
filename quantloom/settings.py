"""Run settings: one flat mapping of defaults plus an overlay that skips ``None``."""

from __future__ import annotations

import copy
from typing import Any

# Defaults of every tunable of the engine.
DEFAULTS: dict[str, Any] = {
    "ewma_lambda_cov": 0.94,
    "rolling_cov_window": 63,
    "fx_hedge_ratio_default": 0.5,
    "regime_method": "ewma_composite",
    "regime_ewma_span": 6,
    "regime_threshold_expansion": 0.5,
    "regime_threshold_stress": -0.5,
    "regime_min_confidence_for_switch": 0.3,
    "adtv_ewma_lambda": 0.97,
    "bootstrap_enabled": True,
    "bootstrap_n_reps": 5000,
    "bootstrap_block_size": 20,
    "bootstrap_seed": 42,
    "bl_views": {"use_macro": True, "macro_view_confidence": 0.20, "macro_view_max_magnitude": 0.015},
    "elasticnet_cv_folds": 5,
    "elasticnet_l1_ratios": [0.1, 0.5, 0.9],
    "elasticnet_max_iter": 10000,
    "forecast_forward_days": 21,
    "forecast_min_train_rows": 50,
    "bl_risk_aversion": 2.5,
    "bl_tau": 0.05,
    "mv_risk_aversion": 4.0,
    "mv_turnover_penalty": 0.05,
    "mv_market_impact_eta": 0.1,
    "cvar_risk_aversion": 25.0,
    "cvar_turnover_penalty": 0.01,
    "cvar_alpha": 0.99,
    "robust_risk_aversion": 4.0,
    "robust_turnover_penalty": 0.05,
    "michaud_n_simulations": 100,
    "michaud_t_effective": 252,
    "target_net_exposure_mv": 0.90,
    "target_net_exposure_cvar": 0.75,
    "target_net_exposure_robust": 0.90,
    "garch_refit_every": 5,
    "garch_forecast_horizon": 21,
    "garch_lookback": 252,
}


def resolve(overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with ``overrides`` on top; a ``None`` override keeps the default."""
    chosen = {k: v for k, v in (overrides or {}).items() if v is not None}
    return {**copy.deepcopy(DEFAULTS), **chosen}
