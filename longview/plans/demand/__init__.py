"""Demand pipelines: shares, hourly profiles, peak hours, device stocks, retail prices."""
