"""Registered queries: each pairs a Spark callable with, where possible, DuckDB SQL."""
