"""Scalar building blocks: names, types, cast rules, value checks, cursors."""
