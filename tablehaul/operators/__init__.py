"""Relational operators: profiles, integrity, key groups, keyset batches, loads, roll-ups."""
