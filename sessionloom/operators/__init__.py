"""Operators: DataFrame to DataFrame jobs over many workspaces and sessions."""
