"""Column expressions for thresholds, monitoring status and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewatch.functions.text import number_text
from scorewatch.values import ERROR_RATE_FAIL, ERROR_RATE_WARN, PSI_FAIL, PSI_WARN


def resolve_thresholds(psi_override: Column, error_override: Column) -> Column:
    """Limits of a model as a struct; overrides replace the fail limits only."""
    return F.struct(
        F.lit(PSI_WARN).alias("psi_warn"),
        F.coalesce(psi_override.cast("double"), F.lit(PSI_FAIL)).alias("psi_fail"),
        F.lit(ERROR_RATE_WARN).alias("error_rate_warn"),
        F.coalesce(error_override.cast("double"), F.lit(ERROR_RATE_FAIL)).alias("error_rate_fail"),
    )


def derive_status(max_psi: Column, error_rate: Column, dq_passed: Column, limits: Column) -> Column:
    """Failed, Rework or Passed; reaching a limit counts as crossing it, and so does missing evidence."""
    over = (max_psi >= limits["psi_fail"]) | (error_rate >= limits["error_rate_fail"]) | ~dq_passed
    failed = over | max_psi.isNull() | error_rate.isNull() | dq_passed.isNull()
    warned = (max_psi >= limits["psi_warn"]) | (error_rate >= limits["error_rate_warn"])
    return F.when(failed, "Failed").when(warned, "Rework").otherwise("Passed")


def failure_reason(max_psi: Column, error_rate: Column, dq_passed: Column, limits: Column) -> Column:
    """Why a run failed, as one line of text."""
    reasons = F.concat_ws(
        "; ",
        F.when(~F.coalesce(dq_passed, F.lit(False)), "data quality checks failed"),
        F.when(max_psi >= limits["psi_fail"], F.concat(F.lit("max PSI "), number_text(max_psi), F.lit(" >= "), number_text(limits["psi_fail"]))),
        F.when(
            error_rate >= limits["error_rate_fail"],
            F.concat(F.lit("error rate "), number_text(error_rate), F.lit(" >= "), number_text(limits["error_rate_fail"])),
        ),
    )
    return F.concat(F.lit("Monitoring failed: "), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("thresholds breached")))


def gate(derived_status: Column, dq_passed: Column) -> Column:
    """Whether the quality step lets the run go on; without a model the checks decide."""
    return F.when(derived_status.isNotNull(), derived_status != "Failed").otherwise(dq_passed)
