"""Micro-batch loading and the event log."""
