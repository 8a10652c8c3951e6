"""Labels, thresholds and limits that results must carry unchanged."""

from decimal import Decimal

# Stock states that take a row out of every health table.
INACTIVE_STATES = ("Discontinued", "Obsolete")

# Stock status, alert type, alert priority, urgency, in falling severity.
OUT_OF_STOCK, CRITICAL, LOW, MODERATE, HEALTHY = (
    "OUT_OF_STOCK",
    "CRITICAL",
    "LOW",
    "MODERATE",
    "HEALTHY",
)
ALERT_TYPES = ("STOCKOUT", "CRITICAL", "LOW_STOCK", "URGENT", "WARNING")
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
URGENCIES = ("IMMEDIATE", "URGENT", "HIGH", "MEDIUM", "LOW")
RISK_CLASSES = ("HIGH RISK", "MODERATE RISK", "LOW RISK")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
ANOMALY_SEVERITIES = ("SEVERE", "MODERATE", "NORMAL")
REORDER_STATES = ("PENDING", "ORDERED", "DELIVERED", "CANCELLED")
DEMAND_ADVICE = (
    "URGENT: Order immediately",
    "WARNING: Plan reorder soon",
    "OK: Monitor",
)
CHANGE_TEXT = ("Unusual stock increase detected", "Unusual stock decrease detected")

# Numeric parameters of the metrics.
NO_DEMAND_DAYS = 999
MODERATE_FACTOR = Decimal("1.5")
COVER_DAYS_IMMEDIATE, COVER_DAYS_URGENT, COVER_DAYS_ATTENTION = 1, 3, 7
RISK_STEPS = (100, 90, 70, 20)
LEAD_BUFFER = 1.5
EOQ_DAYS, EOQ_ORDER_COST = 30, 10
PRIORITY_SCORES = (10, 9, 8, 7, 6, 5)
PRIORITY_SAFETY_SHARE, PRIORITY_REORDER_SHARE = Decimal("0.5"), Decimal("0.75")
URGENT_SCORE = 8
DISPLAY_DAYS_CAP = 60
HALF_REORDER = Decimal("0.5")
CRITICAL_SHARE, LOW_SHARE = Decimal("0.3"), Decimal("0.5")
RISK_ALERT_FLOOR = 70
LOW_TRIAL_SHARE = Decimal("0.8")
RESTOCK_SHARE = 0.25
ABC_VALUE_BANDS = (60, 40)

# Time limits.
ALERT_QUIET_HOURS = 24
REORDER_QUIET_DAYS = 7
ALERT_KEEP_DAYS = 90
LOOKBACK_DAYS = 90
TREND_DAYS = (7, 14, 30, 60, 90)
HISTORY_DAYS = 30

# Trailing window, z-score and volatility limits, projection parameters.
TRAILING_ROWS = 30
Z_MODERATE, Z_SEVERE = 2, 3
CV_HIGH_CONFIDENCE, CV_MEDIUM_CONFIDENCE = 0.2, 0.5
HORIZON_DAYS = 14
VOLATILITY_RANGE, VOLATILITY_SCALE = (0.1, 0.3), 0.05
ACCURACY_BASE, ACCURACY_RANGE = 85, (60, 95)
ACCURACY_VOLATILITY_PENALTY, ACCURACY_LOW_STOCK_PENALTY = 50, 10
BAND_SHARE = 0.15
PROJECTION_RISK_DAYS = (7, 14)
ACCURACY_BINS = 20

# Row limits of the readers and lists.
HEALTH_LIMIT, ALERT_LIMIT, REORDER_LIMIT = 10_000, 5_000, 5_000

# Cleaning tokens.
NULL_TOKENS = ("NULL", "null", "")
STOCK_POLICIES = ("FIFO", "FEFO")
DEFAULT_POLICY, DEFAULT_CLASS = "FIFO", "C"
