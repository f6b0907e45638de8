"""Composed plans (raw -> unified jobs -> documents), the query catalog with
its DuckDB oracle SQL, and the registered queries."""
