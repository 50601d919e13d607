"""Queries over the driver tables, each with DuckDB SQL where SQL can express it."""
