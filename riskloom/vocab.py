"""Names, schemas and thresholds of the credit-account data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names -------------------------------------------------
KEY = "ID"
TARGET = "default_flag"
TARGET_ALIASES = [
    "default_flag",
    "default_payment_next_month",
    "default.payment.next.month",
    "default payment next month",
    "target",
    "default",
]
DEMOGRAPHICS = ["SEX", "EDUCATION", "MARRIAGE", "AGE"]
DELAYS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILLS = [f"BILL_AMT{m}" for m in range(1, 7)]
PAYMENTS = [f"PAY_AMT{m}" for m in range(1, 7)]
WHOLE_NUMBERS = DEMOGRAPHICS + DELAYS
RAW_FEATURES = ["LIMIT_BAL"] + DEMOGRAPHICS + DELAYS + BILLS + PAYMENTS
REQUIRED = ["LIMIT_BAL"] + DEMOGRAPHICS + [TARGET]
PAYMENT_RATIOS = [f"payment_ratio_{m}" for m in range(1, 7)]
AGE_DUMMIES = ["AGE_bin_26-35", "AGE_bin_36-45", "AGE_bin_46-60", "AGE_bin_60+"]
MODEL_FEATURES = (
    RAW_FEATURES + ["utilization_1"] + PAYMENT_RATIOS
    + ["EDUCATION_grouped", "MARRIAGE_grouped"] + AGE_DUMMIES
)

# --- fixed values: bands, cut points and costs ----------------------------------
BANDS = ["APROBADO", "REVISION", "RECHAZO"]
APPROVE_BELOW = 0.20
REVIEW_BELOW = 0.50
DECISION_THRESHOLD = 0.12
BASE_LIMIT = 50_000.0
PSI_WARNING = 0.10
PSI_CRITICAL = 0.25
KS_DECAY_LIMIT = 0.10
PSI_EPSILON = 1e-4
SERVICE_PSI_EPSILON = 1e-6

# inclusive bounds of a valid application; None means unbounded on that side
VALID_RANGES = (
    [("LIMIT_BAL", 0.0, None), ("SEX", 1, 2), ("EDUCATION", 1, 4), ("MARRIAGE", 1, 3), ("AGE", 18, 100)]
    + [(c, -2, 8) for c in DELAYS]
    + [(c, None, None) for c in BILLS]
    + [(c, 0.0, None) for c in PAYMENTS]
)

CLIENT_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType()), T.StructField("LIMIT_BAL", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in WHOLE_NUMBERS]
    + [T.StructField(c, T.DoubleType()) for c in BILLS + PAYMENTS]
    + [T.StructField(TARGET, T.IntegerType())]
)
