"""Registered queries with their SQL counterparts, and plan helpers."""
