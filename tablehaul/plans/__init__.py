"""Dry-run planning, DDL rendering, checkpoints and the run itself."""
