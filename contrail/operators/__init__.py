"""Table operators: ``f(df, ...params) -> DataFrame``, no session globals."""
