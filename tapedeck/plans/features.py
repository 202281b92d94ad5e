"""Feature flags, and the support matrix that they govern."""

from __future__ import annotations

from ..errors import LayoutError

# Flag, category, whether it is on by default.
FLAGS = [
    ("sign_separate", "experimental", True), ("renames_r4_r6", "experimental", False), ("comp_1", "experimental", True), ("comp_2", "experimental", True),
    ("audit_system", "enterprise", False), ("sox_compliance", "enterprise", False), ("hipaa_compliance", "enterprise", False),
    ("gdpr_compliance", "enterprise", False), ("pci_dss_compliance", "enterprise", False), ("security_monitoring", "enterprise", False),
    ("advanced_optimization", "performance", False), ("lru_cache", "performance", True), ("parallel_decode", "performance", False), ("zero_copy", "performance", False),
    ("verbose_logging", "debug", False), ("diagnostic_output", "debug", False), ("profiling", "debug", False), ("memory_tracking", "debug", False),
    ("mutation_testing", "testing", False), ("fuzzing_integration", "testing", False), ("coverage_instrumentation", "testing", False), ("property_based_testing", "testing", False),
]
# Feature, status, the flags that it needs.
SUPPORT = [
    ("level-88", "supported", ()), ("level-66-renames", "partial", ("renames_r4_r6",)), ("occurs-depending", "partial", ()),
    ("edited-pic", "supported", ()), ("comp-1-comp-2", "supported", ("comp_1", "comp_2")), ("sign-separate", "supported", ("sign_separate",)), ("nested-odo", "partial", ()),
]


def flags(changes: dict[str, bool] | None = None) -> dict[str, bool]:
    """Every flag's state: the defaults with ``changes``."""
    state = {name: on for name, _, on in FLAGS}
    for name, on in (changes or {}).items():
        if name.lower() not in state:
            raise LayoutError("CBKP011", f"no feature flag {name}")
        state[name.lower()] = on
    return state


def flag_table(spark, changes: dict[str, bool] | None = None):
    """(flag, category, by_default, enabled)."""
    state = flags(changes)
    return spark.createDataFrame([(n, c, d, state[n]) for n, c, d in FLAGS], "flag string, category string, by_default boolean, enabled boolean")


def support_matrix(spark, changes: dict[str, bool] | None = None):
    """(feature, status, needed, missing, available): what is supported, and whether the flags
    that it needs are on."""
    from pyspark.sql import functions as F

    needs = spark.createDataFrame([(i, f, s, list(n)) for i, (f, s, n) in enumerate(SUPPORT)], "place int, feature string, status string, flags array<string>")
    on = flag_table(spark, changes).select("flag", "enabled")
    j = needs.select("place", "feature", "status", F.explode_outer("flags").alias("flag")).join(on, "flag", "left")
    out = j.groupBy("place", "feature", "status").agg(F.count("flag").cast("int").alias("needed"), F.count_if(~F.col("enabled")).cast("int").alias("missing"))
    return out.select("feature", "status", "needed", "missing", (F.col("missing") == 0).alias("available"))
