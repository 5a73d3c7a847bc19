"""Ratios of hardware counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import ratio

# The names of the eleven derived metrics, the counters they read, the cache line of 64 bytes and the clock factors.
LINE_BYTES = 64
CLOCK_HZ = 1.09e9
CLOCK_SHORT = 1.1
COUNTERS = [
    "BRANCHES", "BRANCHES_MISPREDICTED", "FE_STALLED", "CPU_CLK_UNHALTED", "VPU_INSTRUCTIONS_EXECUTED", "INSTRUCTIONS_EXECUTED",
    "VPU_DATA_READ", "VPU_DATA_WRITE", "DATA_READ_OR_WRITE", "VPU_DATA_READ_MISS", "VPU_DATA_WRITE_MISS", "DATA_READ_MISS_OR_WRITE_MISS",
    "L1_DATA_HIT_INFLIGHT_PF1", "L2_DATA_READ_MISS_CACHE_FILL", "L2_DATA_WRITE_MISS_CACHE_FILL", "L2_DATA_READ_MISS_MEM_FILL",
    "L2_DATA_WRITE_MISS_MEM_FILL", "L2_VICTIM_REQ_WITH_DATA", "HWP_L2MISS", "SNP_HITM_L2",
]


def metrics() -> dict[str, Column]:
    """The derived metrics by name, from columns named as COUNTERS; null where a denominator is 0."""
    c = {n: F.col(n).cast("double") for n in COUNTERS}
    mem = c["L2_DATA_READ_MISS_MEM_FILL"] + c["L2_DATA_WRITE_MISS_MEM_FILL"]
    cache = c["L2_DATA_READ_MISS_CACHE_FILL"] + c["L2_DATA_WRITE_MISS_CACHE_FILL"]
    misses = c["DATA_READ_MISS_OR_WRITE_MISS"] + c["L1_DATA_HIT_INFLIGHT_PF1"]
    traffic = ratio(LINE_BYTES * (mem + c["L2_VICTIM_REQ_WITH_DATA"] + c["HWP_L2MISS"] + c["SNP_HITM_L2"]), c["CPU_CLK_UNHALTED"])
    return {
        "Branch Miss Ratio": ratio(c["BRANCHES_MISPREDICTED"], c["BRANCHES"]),
        "FE_STALLED Per K-Cycles": ratio(1000 * c["FE_STALLED"], c["CPU_CLK_UNHALTED"]),
        "VPU Instructions Ratio": ratio(c["VPU_INSTRUCTIONS_EXECUTED"], c["INSTRUCTIONS_EXECUTED"]),
        "VPU Data Read Or Write Ratio": ratio(c["VPU_DATA_READ"] + c["VPU_DATA_WRITE"], c["DATA_READ_OR_WRITE"]),
        "VPU Data R/W Miss Ratio": ratio(c["VPU_DATA_READ_MISS"] + c["VPU_DATA_WRITE_MISS"], c["DATA_READ_MISS_OR_WRITE_MISS"]),
        "Cache Miss Per K-Instructions": ratio(1000 * misses, c["INSTRUCTIONS_EXECUTED"]),
        "Memory Bandwidth": traffic * CLOCK_HZ,
        "L2 Mem Fill Ratio": ratio(mem, cache + mem),
        "L2 Cache Fill Ratio": ratio(cache, cache + mem),
        "L2 Cache Hit Ratio": ratio(misses, cache + mem),
        "Bandwidth": traffic * CLOCK_SHORT,
    }
