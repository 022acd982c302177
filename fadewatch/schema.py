"""Table schemas, the fixed signal and feature names, and the leakage guard."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

T_MAX = 100  # cycles kept per entity; no feature may look beyond

# The per-cycle signals, in table order.
SIGNALS = [
    "qd", "qc", "ir",
    "t_bml_chg", "t_chg", "t_dis", "t_cv", "t_rest",
    "e_dis", "e_chg", "v_dis_avg",
    "i_chg_mean", "i_chg_std", "i_max",
    "temp_mean", "temp_max", "temp_min",
]

# Columns that know the future of an entity and may never feed a feature.
FORBIDDEN_INPUTS = ["label", "legacy_label", "qd_full", "n_cycles_recorded"]

CELLS = T.StructType(
    [
        T.StructField("cell_id", T.StringType(), False),
        T.StructField("nominal_capacity_ah", T.DoubleType()),
        T.StructField("min_voltage_v", T.DoubleType()),
        T.StructField("max_voltage_v", T.DoubleType()),
        T.StructField(
            "charge_protocol",
            T.ArrayType(T.StructType([T.StructField("rate_in_C", T.DoubleType()), T.StructField("end_soc", T.DoubleType())])),
        ),
    ]
)

POINTS = T.StructType(
    [T.StructField("cell_id", T.StringType(), False), T.StructField("cycle_idx", T.IntegerType(), False),
     T.StructField("pt_idx", T.LongType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in ("t", "i", "v", "temp", "qd", "qc")]
)

CYCLES = T.StructType(
    [
        T.StructField("cell_id", T.StringType(), False),
        T.StructField("cycle_idx", T.IntegerType(), False),
        T.StructField("cycle_number", T.IntegerType()),
        T.StructField("ir", T.DoubleType()),
        T.StructField("qdlin", T.ArrayType(T.FloatType())),
    ]
)

RAW_CELL = T.StructType(
    [
        T.StructField("cell_id", T.StringType(), False),
        T.StructField("nominal_capacity_in_Ah", T.DoubleType()),
        T.StructField("min_voltage_limit_in_V", T.DoubleType()),
        T.StructField("max_voltage_limit_in_V", T.DoubleType()),
        CELLS["charge_protocol"],
        T.StructField(
            "cycle_data",
            T.ArrayType(
                T.StructType(
                    [T.StructField("cycle_number", T.IntegerType())]
                    + [
                        T.StructField(c, T.ArrayType(T.DoubleType()))
                        for c in ("current_in_A", "voltage_in_V", "time_in_s", "temperature_in_C",
                                  "discharge_capacity_in_Ah", "charge_capacity_in_Ah", "Qdlin")
                    ]
                    + [T.StructField("internal_resistance_in_ohm", T.DoubleType())]
                )
            ),
        ),
    ]
)

# Named column lists of the reference feature set.
VARIANCE_MODEL = ["dq_var_log"]
DISCHARGE_MODEL = ["dq_min_log", "dq_var_log", "dq_skew_log", "dq_kurt_log", "qd_early", "qd_max_minus_early"]
FULL_MODEL = ["dq_min_log", "dq_var_log", "qd_slope", "qd_intercept", "qd_early",
              "t_early_chg_log", "temp_avg_log", "ir_min", "ir_change"]
SET_A = ["dq_min_log", "dq_var_log", "dq_skew_log", "dq_kurt_log", "qd_early", "qd_max_minus_early",
         "qd_slope", "qd_intercept", "t_early_chg_log", "temp_avg_log", "ir_min", "ir_change"]


class ForbiddenInputError(KeyError):
    """A feature input holds future information."""


def assert_feature_inputs(columns: Iterable[str] | DataFrame) -> None:
    names = columns.columns if isinstance(columns, DataFrame) else list(columns)
    bad = [c for c in names if c in FORBIDDEN_INPUTS]
    if bad:
        raise ForbiddenInputError(f"columns {bad} hold future information and are not feature inputs")
