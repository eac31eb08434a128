"""Structured Streaming forms of chunk assembly, status, batch completion and expiry.

Keys hold only counts in state, aggregated before the shuffle, and leave the state once
the watermark passes their start time. Chunk bodies and pages are never kept in state.
"""
