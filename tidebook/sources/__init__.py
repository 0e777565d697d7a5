"""Readers and writers: raw ticks, the per-day cache, text reports."""
