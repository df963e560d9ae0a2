"""Operators over log relations; each takes and returns DataFrames."""
