"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

EVENT_LINE = (
    "schema_version int, seq long, ts string, elapsed_s double, run_id string, job_id string, "
    "type string, data string"
)

# The resource metrics of a sample.
RESOURCE_KEYS = [
    "cpu_percent",
    "ram_used_mb",
    "ram_total_mb",
    "process_rss_mb",
    "gpu_util_percent",
    "gpu_mem_used_mb",
    "gpu_mem_total_mb",
    "gpu_power_w",
    "gpu_temp_c",
    "gpu_encoder_percent",
]
