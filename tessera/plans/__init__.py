"""Registered queries: the operators over the driver's tables, each beside its DuckDB SQL."""
