"""Thresholds and registries.  Everything in this module is a fixed value."""

from __future__ import annotations

# --- fixed values: market registry (symbol, exchange, cftc_code, multiplier,
# --- strike_range, has_options, tier)
MARKETS = [
    ("HE", "CME", "054642", 400.0, 15.0, True, 1),
    ("LE", "CME", "057642", 400.0, 15.0, True, 1),
    ("GF", "CME", "061641", 500.0, 15.0, True, 1),
    ("DC", "CME", "052641", 2000.0, 5.0, True, 2),
    ("ZC", "CBOT", "002602", 50.0, 50.0, True, 1),
    ("ZW", "CBOT", "001602", 50.0, 50.0, True, 1),
    ("ZM", "CBOT", "026603", 100.0, 30.0, True, 2),
    ("ZL", "CBOT", "007601", 600.0, 5.0, True, 2),
    ("KE", "CBOT", "001612", 50.0, 50.0, True, 2),
    ("CC", "NYBOT", "073732", 10.0, 500.0, True, 2),
    ("KC", "NYBOT", "083731", 375.0, 30.0, True, 2),
    ("CT", "NYBOT", "033661", 500.0, 10.0, True, 2),
    ("SB", "NYBOT", "080732", 1120.0, 5.0, True, 2),
    ("OJ", "NYBOT", "040701", 150.0, 20.0, True, 3),
]

# --- fixed values: data quality
FUTURES_STALE_DAYS = 1
OPTIONS_STALE_DAYS = 1
COT_STALE_DAYS = 7
MIN_LIQUID_STRIKES = 8
MAX_SPREAD_PCT = 0.20
MIN_OI = 50
REVISION_WEEKS = 4

# --- fixed values: options math
RISK_FREE_RATE = 0.05
DENSITY_MIN_OI = 10
DENSITY_MAX_SPREAD_PCT = 0.50
DENSITY_GRID = 200
ARBITRAGE_GRID = 500
CHAIN_EXPIRIES = 3
CHAIN_STRIKE_RANGE = 15.0

# --- fixed values: stored features, then the five computed ones
STORE_FEATURES = [
    "cot_managed_money_net",
    "cot_producer_net",
    "cot_swap_net",
    "cot_total_oi",
    "implied_mean",
    "implied_variance",
    "implied_skew",
    "implied_kurtosis",
    "atm_iv",
    "gex",
    "vanna_flow",
    "charm_flow",
]
SIGNAL_FEATURES = [
    "divergence_direction",
    "divergence_magnitude",
    "divergence_confidence",
    "sentiment_score",
    "sentiment_confidence",
]
COT_FEATURES = {
    "cot_managed_money_net": "managed_money_net",
    "cot_producer_net": "producer_net",
    "cot_swap_net": "swap_net",
    "cot_total_oi": "total_oi",
}

# --- fixed values: composite fitness (weight, low, high, lower is better)
FITNESS = {
    "sharpe": (0.25, -1.0, 3.0, False),
    "drawdown": (0.20, -0.50, 0.0, False),
    "calibration": (0.15, 0.0, 0.5, True),
    "robustness": (0.15, 0.0, 1.0, False),
    "slippage_adjusted_return": (0.15, -0.50, 1.0, False),
    "simplicity": (0.10, 0.0, 1.0, False),
}

# --- fixed values: drift thresholds
PSI_BINS = 10
PSI_EPSILON = 1e-4
PSI_THRESHOLD = 0.25
KS_ALPHA = 0.05
CUSUM_THRESHOLD = 5.0
CUSUM_SLACK = 0.5
ADWIN_DELTA = 0.002
ADWIN_GRACE = 30
SHARPE_DEGRADATION = 0.5
DRAWDOWN_ALERT = -0.15
HIT_RATE_FLOOR = 0.45
BRIER_OVERFIT = 0.3

# --- fixed values: experiment budget
BUDGET_PER_CYCLE = 5
BUDGET_PER_CATEGORY = {
    "hyperparameter": 3,
    "feature_add": 2,
    "feature_remove": 2,
    "feature_engineering": 2,
    "ensemble_method": 1,
    "prediction_target": 1,
}
COOLDOWN_DAYS = {
    "hyperparameter": 3,
    "feature_add": 7,
    "feature_remove": 7,
    "ensemble_method": 14,
}

# --- fixed values: cause -> recommended mutation types
CAUSE_MUTATIONS = {
    "performance_degradation": ["hyperparameter", "feature_remove"],
    "feature_distribution_drift": ["feature_engineering", "hyperparameter"],
    "regime_change": ["ensemble_method", "hyperparameter"],
    "overfitting": ["hyperparameter", "feature_remove"],
    "data_quality_issue": ["feature_remove"],
}

# --- fixed values: playbook (cause, slot, mutation type, name, parameter, expression);
# --- an entry with two parameters takes two lines under one slot
PLAYBOOK = [
    ("performance_degradation", 0, "hyperparameter", "reduce_learning_rate", "learning_rate", "current * 0.5"),
    ("performance_degradation", 1, "hyperparameter", "increase_regularization", "reg_alpha", "current * 2"),
    ("performance_degradation", 1, "hyperparameter", "increase_regularization", "reg_lambda", "current * 2"),
    ("performance_degradation", 2, "feature_remove", "drop_low_importance_features", "drop_features", "bottom 3 by SHAP"),
    ("feature_distribution_drift", 0, "feature_engineering", "shorten_training_window", "training_window", "current * 0.7"),
    ("feature_distribution_drift", 1, "feature_engineering", "add_rolling_z_scores", "add_features", '["z_score_30d", "z_score_90d"]'),
    ("regime_change", 0, "ensemble_method", "add_regime_conditioning", "ensemble_type", "regime_conditional"),
    ("regime_change", 1, "hyperparameter", "increase_num_leaves", "num_leaves", "current * 1.5"),
    ("overfitting", 0, "hyperparameter", "reduce_num_leaves", "num_leaves", "max(8, current // 2)"),
    ("overfitting", 1, "hyperparameter", "increase_min_child_samples", "min_child_samples", "current * 2"),
    ("overfitting", 2, "feature_remove", "add_dropout", "feature_fraction", "current * 0.7"),
    ("data_quality_issue", 0, "feature_remove", "remove_degraded_features", "drop_features", "features_with_high_psi"),
    ("data_quality_issue", 1, "hyperparameter", "reduce_training_window", "training_window", "current * 0.5"),
]

# --- fixed values: why a playbook entry should help, and what is then expected
RATIONALES = {
    "reduce_learning_rate": "Slower learning rate reduces overshoot on noisy gradients",
    "increase_regularization": "Stronger L1/L2 regularization reduces model variance",
    "drop_low_importance_features": "Remove noisy features with lowest SHAP importance",
    "shorten_training_window": "Shorter window weights recent regime more heavily",
    "add_rolling_z_scores": "Z-scored features are distribution-invariant",
    "add_regime_conditioning": "Regime-aware ensemble adapts to market state transitions",
    "increase_num_leaves": "More leaves capture regime-specific decision boundaries",
    "reduce_num_leaves": "Fewer leaves reduce model complexity and overfitting risk",
    "increase_min_child_samples": "Higher minimum samples per leaf prevents memorization",
    "add_dropout": "Feature subsampling acts as dropout regularization",
    "remove_degraded_features": "Remove features with distribution shift indicating data quality issues",
    "reduce_training_window": "Shorter window avoids stale/corrupted historical data",
}
PREDICTION = "Applying %s should improve model performance on the next sandbox evaluation"

# --- fixed values: sentences of a diagnosis
EVIDENCE = {
    "sharpe_degraded": "Sharpe ratio degraded (current: %.3f)",
    "drawdown_alert": "Drawdown alert triggered (max drawdown: %.3f)",
    "hit_rate_degraded": "Hit rate degraded (current: %.3f)",
    "drifted_features": "%d features drifted: %s",
    "streaming_alerts": "Streaming alert for %s",
}
REASONING = ("Diagnosed %s with confidence %.2f", ". Evidence: %s.", ". No strong signals detected; using default classification.")

# --- fixed values: default classifier settings that playbook expressions refer to
DEFAULT_MODEL_CONFIG = {
    "learning_rate": 0.1,
    "reg_alpha": 0.1,
    "reg_lambda": 0.1,
    "training_window": 252.0,
    "num_leaves": 31.0,
    "min_child_samples": 20.0,
    "feature_fraction": 0.8,
}

# --- fixed values: walk-forward and ledger
WALK_FORWARD = {"n_splits": 5, "embargo": 5, "min_train": 252, "test_size": 63}
LEDGER = {
    "initial_capital": 100_000.0,
    "kelly_fraction": 0.5,
    "max_position_pct": 0.10,
    "max_volume_pct": 0.02,
    "contract_value": 1000.0,
    "impact_coefficient": 0.1,
    "threshold": 0.5,
    "static_spread": 0.50,
    "static_volume": 5000.0,
    "static_volatility": 0.02,
}
BREAKERS = {
    "max_daily_loss": (-0.02, False),
    "max_drawdown": (-0.05, False),
    "max_position_size": (0.10, True),
    "max_single_trade_loss": (-0.01, False),
}
BREAKER_COOLDOWN = 1
ROLLBACK = {"drop": 0.15, "sustained": 3, "recovery": 5, "cooldown": 10}
