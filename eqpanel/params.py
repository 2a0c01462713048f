"""Versioned parameters.

Fixed values: windows, thresholds, weights and limits that results depend on.
Operators take them as arguments, with these as the defaults.
"""

VERSION = "panel-parameters-1"

# --- data quality -----------------------------------------------------------
DQ_CONFIDENCE_CAP = 70
DQ_ACTIONABLE_BLOCK = 50
DQ_FAIL_PENALTY = 35
DQ_WARN_PENALTY = 10
HARD_BLOCK_CODES = (
    "INVALID_DATE", "MISSING_SESSION", "STALE_DATA", "PRICE_BAND_BREACH",
    "TRADING_STATUS_BLOCKED", "UNIT_UNKNOWN", "RAW_ADJUSTED_AMBIGUOUS",
    "LINEAGE_MISSING", "PROVIDER_NOT_ADMITTED", "UNRESOLVED_CORPORATE_ACTION",
    "DUPLICATE_BAR", "OHLC_LOGIC", "NEGATIVE_VOLUME", "NONPOSITIVE_PRICE",
)

# --- features ---------------------------------------------------------------
RS_HORIZONS = (20, 126)
MA_WINDOWS = (20, 50, 200)
RSI_WINDOW = 14
ZSCORE_WINDOW = 60
ZSCORE_MIN_OBS = 20
WINSOR = (0.01, 0.99)
PULLBACK_VOLUME_SHORT = 5
PULLBACK_VOLUME_MULTIPLIER = 1.10
PULLBACK_TREND_BUFFER = 0.02
PULLBACK_MA_DISTANCE = (-0.04, 0.02)
REVERSAL_RSI_MAX = 32
REVERSAL_CLOSE_LOCATION_MIN = 0.60
SETUP_WEIGHTS = {"trend": 0.35, "ma_distance": 0.25, "reclaim": 0.20, "volatility": 0.20}
SETUP_MA_DISTANCE_SCALE = 0.06
SETUP_ATR_SCALE = 0.08
VOLUME_SCORE_NEUTRAL = 0.5
VOLUME_SCORE_SLOPE = 0.2

# --- market state -----------------------------------------------------------
EQUAL_WEIGHT_BASE = 1000.0
AD_SLOPE_WINDOW = 10
TURNOVER_WINDOW = 20
TURNOVER_MIN_OBS = 10
STRONG_BREADTH_MIN = 0.60
STRONG_TURNOVER_MIN = 1.00
CONCENTRATED_BREADTH_MIN = 0.45
CONCENTRATED_TURNOVER_MIN = 0.85
RANGE_BREADTH_MIN = 0.35
RISK_OFF_BREADTH_MIN = 0.25
REGIMES = ("PANIC_BEAR", "RISK_OFF", "RANGE", "CONCENTRATED_BULL", "STRONG_BULL")
SECTOR_WEIGHTS = {"rs20": 0.30, "rs126": 0.30, "breadth": 0.25, "volume_impulse": 0.15}

# --- candidates -------------------------------------------------------------
RS_LONG_MIN = 60.0
RS_SHORT_PULLBACK_MAX = 40.0
RS_SHORT_MOMENTUM_MIN = 65.0
RS_SHORT_REVERSAL_MAX = 25.0
SECTOR_MIN = 45.0
MOMENTUM_VOLUME_Z_MIN = 0.5
SCORE_WEIGHTS = {"long_rs": 0.35, "short_rs": 0.15, "sector": 0.25, "setup": 0.15, "volume": 0.10}
NEUTRAL_COMPONENT = 0.5
NEUTRAL_SECTOR_SCORE = 50.0
SCORE_MAX = 100.0

# --- execution and outcomes ---------------------------------------------------
SLIPPAGE_BPS = 15.0
EXCHANGE_FEE_RATE = 0.00027
SELL_TAX_RATE = 0.001
HOLD_SESSIONS = 20
ENTRY_PREMIUM = 0.005
MAXIMUM_GAP = 0.02
PRICE_BAND = 0.07
VENUE_BANDS = {"HOSE": 0.07, "HNX": 0.10, "UPCOM": 0.15}
# (price below, tick); the last tick has no upper price
TICK_RULES = ((10000, 10), (50000, 50), (None, 100))
MIN_FACTOR_JUMP = 0.005

# --- validation -------------------------------------------------------------
EMBARGO_BUFFER = 21
MIN_SAMPLES = 30
MIN_FILL_RATE = 0.70
MIN_PLACEBO_ADVANTAGE = 0.20
MIN_AUC = 0.52
CALIBRATION_EDGES = (0.2, 0.4, 0.6, 0.8, 1.0)

# --- portfolio risk -----------------------------------------------------------
LOT_SIZE = 100
RISK_PER_TRADE = 0.01
MIN_STOP_FRACTION = 0.01
MAX_STOP_FRACTION = 0.20
MIN_NOTIONAL = 10_000_000
MAX_POSITIONS = 10
MAX_CORRELATED_POSITIONS = 2
MAX_SECURITY_EXPOSURE = 0.10
MAX_SECTOR_EXPOSURE = 0.35
MAX_CORRELATED_EXPOSURE = 0.15
MAX_ADV_PARTICIPATION = 0.03
MAX_OPEN_RISK = 0.05
# regime: (total exposure, risk multiplier)
REGIME_LIMITS = {
    "STRONG_BULL": (1.0, 1.0),
    "CONCENTRATED_BULL": (0.8, 0.8),
    "RANGE": (0.6, 0.6),
    "RISK_OFF": (0.4, 0.4),
    "PANIC_BEAR": (0.0, 0.0),
}

# --- sizes ------------------------------------------------------------------
# A window group may be sorted by one task only when its size is known to stay
# below this; larger or unknown groups take the split path (functions/ordered.py).
MAX_WINDOW_GROUP = 1_000_000
# Rows one task folds in priority order before the round-based path is used.
MAX_FOLD_GROUP = 20_000
# Rows of a key folded in each round of that path.
FOLD_PREFIX = 200
# Symbols whose series one task sorts, in panels of more (functions/series.py).
SYMBOLS_PER_TASK = 400
