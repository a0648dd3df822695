"""Registered queries: each module has QUERIES (name to callable) and ORACLES (name to DuckDB SQL)."""
