"""Fixed values the results depend on: default prices, thresholds, weights, calendars.

They are business constants, kept together and in plain order.
"""

DEFAULT_PRICE, DEFAULT_COST_RATIO, DEFAULT_RETURN_RATE = 1.8, 0.78, 0.02

# --- fixed values: calendar and region rules ---
NORMAL_DAY = "Normal Day"
NO_HOLIDAY = "None"
QUAKE_WORD = "terremoto"
COASTAL_STATES = [
    "Guayas",
    "Manabi",
    "Los Rios",
    "El Oro",
    "Santa Elena",
    "Esmeraldas",
    "Santo Domingo de los Tsachilas",
    "Santo Domingo",
]
COASTAL_SCHOOL_MONTHS = [4, 5]
INLAND_SCHOOL_MONTHS = [8, 9]
TIER1_CLUSTERS = [5, 11]

# --- fixed values: series features ---
LOG_LAGS = [1, 2, 3, 7, 14, 21, 28]
LOG_MEAN_WINDOWS = [7, 14, 28]
SALES_LAGS = [7, 14, 28]
SALES_MEAN_WINDOWS = [7, 14, 30]
SALES_STD_WINDOWS = [7, 28]
DAYS_SINCE_SALE_CAP = 56
FEATURE_SPEC_VERSION = "v2.1"

# --- fixed values: inventory and merchandising thresholds ---
HORIZON_DAYS = 16
DAY_BIT = 57  # where the day starts in a row id
SERVICE_Z = 1.65
DEMAND_CV = 0.2
DEFAULT_LEAD_TIME = 3
STOCKOUT_UNIT_LOSS_USD = 5.0
CRITICAL_LOSS_USD = 100
LOW_STOCK_PER_STORE = 30
OVERSTOCK_DAYS = 30.0
COVER_CAP_DAYS = 999.0
DEFAULT_FAMILY_RMSLE = 0.357
SHARE_LOOKBACK_DAYS = 45
TARGET_SMOOTHING = 10.0
RECENCY_HALF_LIFE_DAYS = 180.0
WMAPE_PERISHABLE_WEIGHT = 1.5
NWRMSLE_PERISHABLE_WEIGHT = 1.25
ROUTE_TOLERANCE = 1.3
SCENARIO_DEFAULT_PRICE = 5.0

# --- fixed values: conversation limits ---
CHAT_ROLES = ["user", "assistant"]
CHAT_TOKEN_BUDGET = 1200
CHARS_PER_TOKEN = 2.5
NUMBER_PATTERN = r"(-?\d[\d.,]*)"
