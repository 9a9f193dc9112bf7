"""DuckDB SQL that gives the same rows as the registered queries."""
