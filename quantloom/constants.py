"""Fixed values.

Everything in this module is a value that results depend on (column lists, default
fills, rule tables, bounds, scenario definitions).  They are stated plainly; no logic
lives here.
"""

# Calendar
TRADING_DAYS = 252
BUSINESS_EPOCH = "1900-01-01"  # a Monday
PUBLICATION_LAG_DAYS = 90
FORWARD_FILL_LIMIT = 5
MIN_PRICE_HISTORY = 126

# Canonical table columns
EQUITY_FUNDAMENTALS = [
    "pe_ratio", "pb_ratio", "roe", "profit_margin",
    "net_debt_to_ebitda", "ebitda_growth", "capex_to_sales",
]
FIBRA_FUNDAMENTALS = ["cap_rate", "ffo_yield", "dividend_yield", "ltv", "vacancy_rate"]
BOND_COLUMNS = ["asset_class", "price", "ytm", "duration", "credit_spread"]
MACRO_COLUMNS = [
    "IMAI", "industrial_production_yoy", "exports_yoy", "usd_mxn",
    "banxico_rate", "inflation_yoy", "us_ip_yoy", "us_fed_rate",
]

# Neutral fills used where real history exists but single cells are missing
EQUITY_DEFAULTS = {
    "pe_ratio": 14.0, "pb_ratio": 1.8, "roe": 0.12, "profit_margin": 0.08,
    "net_debt_to_ebitda": 2.5, "ebitda_growth": 0.05, "capex_to_sales": 0.05,
}
FIBRA_DEFAULTS = {
    "cap_rate": 0.075, "ffo_yield": 0.065, "dividend_yield": 0.055,
    "ltv": 0.35, "vacancy_rate": 0.08,
}

# Vendor field names -> canonical column names
FUNDAMENTAL_FIELDS = {
    "PE_RATIO": "pe_ratio", "PX_TO_BOOK_RATIO": "pb_ratio", "RETURN_ON_EQUITY": "roe",
    "PROF_MARGIN": "profit_margin", "NET_DEBT_TO_EBITDA": "net_debt_to_ebitda",
    "EBITDA_GROWTH": "ebitda_growth", "CAPEX_TO_SALES": "capex_to_sales",
}
FIBRA_FIELDS = {
    "CAP_RATE": "cap_rate", "FFO_YIELD": "ffo_yield", "DVD_SH_12M": "dividend_yield",
    "LOAN_TO_VALUE": "ltv", "VACANCY_RATE": "vacancy_rate",
}
BOND_FIELDS = {
    "PX_LAST": "price", "YLD_YTM_MID": "ytm", "DUR_MID": "duration", "Z_SPRD_MID": "credit_spread",
}
MACRO_FIELDS = {
    "MMACTIVI Index": "IMAI", "MXIPYOY Index": "industrial_production_yoy",
    "MXEXPORT Index": "exports_yoy", "USDMXN Curncy": "usd_mxn",
    "MXONBRAN Index": "banxico_rate", "MXCPYOY Index": "inflation_yoy",
    "IP YOY Index": "us_ip_yoy", "FDTR Index": "us_fed_rate",
}

# Government bond series and their representative terms
BOND_SERIES = {
    "SF43936": "CETES28", "SF43939": "CETES91", "SF43773": "MBONO3Y",
    "SF43774": "MBONO5Y", "SF43775": "MBONO10Y",
}
BOND_TERMS = {
    "CETES28": {"maturity": 28 / 365, "duration": 28 / 365, "coupon_rate": 0.0},
    "CETES91": {"maturity": 91 / 365, "duration": 91 / 365, "coupon_rate": 0.0},
    "MBONO3Y": {"maturity": 3.0, "duration": 2.7, "coupon_rate": 0.075},
    "MBONO5Y": {"maturity": 5.0, "duration": 4.3, "coupon_rate": 0.080},
    "MBONO10Y": {"maturity": 10.0, "duration": 7.5, "coupon_rate": 0.085},
}
MACRO_SERIES = {"SF43783": "banxico_rate", "SP1": "inflation_index", "SF60653": "usd_mxn_banxico"}

# Symbol resolution: text that marks an already qualified symbol, per provider
QUALIFIED_MARKS = {
    "yahoo": {"prefix": ["^"], "contains": []},
    "bloomberg": {"prefix": [], "contains": [" Equity", " Index", " Govt"]},
    "lseg": {"prefix": [], "contains": ["=", "."]},
}

# Feature sets
EQUITY_MODEL_FEATURES = [
    "momentum_63", "momentum_126", "volatility_63",
    "pe_ratio", "pb_ratio", "roe", "profit_margin", "net_debt_to_ebitda",
    "ebitda_growth", "capex_to_sales",
    "industrial_production_yoy", "usd_mxn", "exports_yoy",
]
FIBRA_MODEL_FEATURES = [
    "momentum_63", "volatility_63",
    "cap_rate", "ffo_yield", "dividend_yield", "ltv", "vacancy_rate",
    "industrial_production_yoy", "usd_mxn",
]
SCORE_COLUMNS = ["momentum_63", "value_score", "quality_score", "liquidity_score"]
SIGNAL_COLUMNS = [
    "momentum_63", "momentum_126", "volatility_63",
    "value_score", "quality_score", "liquidity_score",
]

# Macro signal -> sector sign table for allocation views
MACRO_SECTOR_RULES = {
    "industrial_production_yoy": {"Industrial": 1.0, "Logistics": 0.5, "Infrastructure": 0.5},
    "exports_yoy": {"Industrial": 1.0, "Logistics": 0.7},
    "us_ip_yoy": {"Industrial": 0.8, "Logistics": 0.6},
    "banxico_rate_delta": {"FIBRA": -1.0, "Infrastructure": -0.4},
    "inflation_yoy": {"FIBRA": -0.4},
}

# Regime tables
REGIME_BOUNDS = {
    "expansion": {"equity": (0.55, 0.90), "fibra": (0.05, 0.25), "fixed_income": (0.00, 0.10)},
    "tightening": {"equity": (0.45, 0.75), "fibra": (0.05, 0.20), "fixed_income": (0.05, 0.20)},
    "stress": {"equity": (0.35, 0.60), "fibra": (0.03, 0.15), "fixed_income": (0.10, 0.30)},
}
SLEEVE_BOUNDS = {"expansion": (0.03, 0.05), "tightening": (0.05, 0.08), "stress": (0.08, 0.15)}
ISSUER_LIMIT = 0.10
MAX_POSITION = 0.10

# Sector anchor groups and exposure groups
ANCHOR_GROUPS = {
    "Industrial": ["Industrial", "Logistics", "Infrastructure", "Materials", "Consumer", "Communication"],
    "FIBRA": ["FIBRA"],
}
REPORT_BUCKETS = {
    "Industrial": ["Industrial", "Logistics", "Infrastructure", "Energy", "Materials", "Consumer", "Communication"],
    "FIBRA": ["FIBRA"],
    "Government": ["Government"],
}
INDUSTRIAL_EXPOSURE_SECTORS = ["Industrial", "Logistics", "Materials", "Infrastructure"]

# Stress scenarios
SCENARIO_SHOCKS = {
    "banxico_shock": -0.03, "peso_depreciation": -0.05,
    "us_slowdown": -0.04, "tmec_disruption": -0.07,
}
FALLBACK_STRESS_WINDOWS = [
    ("2020-03-02", "2020-03-31", "2020-03 COVID shock"),
    ("2022-10-03", "2022-10-31", "2022-10 global tightening"),
    ("2025-02-03", "2025-02-24", "2025-02 tariff shock"),
    ("2018-05-30", "2018-06-29", "2018-06 NAFTA acero/aluminio tariffs"),
    ("2019-05-30", "2019-06-07", "2019-06 amenaza arancel migratorio MX"),
]

# Structural long/short scenarios:
# key, label, longs, shorts, sector neutral, net, gross, leverage cap, mode
STRUCTURE_SCENARIOS = [
    ("regulated", "Regulado (LFI actual)", 8, 0, False, 1.05, 1.15, 1.15, "regulated"),
    ("130_30", "130/30", 8, 5, False, 1.00, 1.60, 1.60, "analytical"),
    ("market_neutral", "Market-Neutral", 8, 8, False, 0.00, 1.00, 1.00, "analytical"),
    ("130_30_sector_neutral", "130/30 Sector-Neutral", 2, 1, True, 1.00, 1.60, 1.60, "analytical"),
]

# Parameter search: key -> (kind, low, high, log scale); categorical carries its choices
SEARCH_SPACE = {
    "bl_risk_aversion": ("float", 1.0, 5.0, True),
    "bl_tau": ("float", 0.01, 0.15, True),
    "mv_risk_aversion": ("float", 1.0, 10.0, True),
    "mv_turnover_penalty": ("float", 0.01, 0.5, True),
    "mv_market_impact_eta": ("float", 0.01, 0.5, True),
    "cvar_risk_aversion": ("float", 5.0, 50.0, True),
    "ewma_lambda_cov": ("float", 0.90, 0.99, False),
    "elasticnet_l1_ratios": ("categorical", [[0.1, 0.5, 0.9], [0.1, 0.9], [0.5], [0.9]], None, None),
    "regime_ewma_span": ("int", 3, 12, False),
    "forecast_forward_days": ("int", 10, 42, False),
    "adtv_ewma_lambda": ("float", 0.90, 0.99, False),
}
REGULATED_KEYS = [
    "max_position", "max_position_mv", "max_position_cvar", "max_position_robust",
    "issuer_concentration_limit", "fx_overlay_notional_cap",
    "liquidity_sleeve_expansion", "liquidity_sleeve_tightening", "liquidity_sleeve_stress",
]

EULER_MASCHERONI = 0.5772156649015329
