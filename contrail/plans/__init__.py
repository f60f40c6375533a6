"""Question-level plans: each registered query composes operators over the
given tables (via stand-ins) and carries an equivalent DuckDB SQL oracle."""
