"""Column and window builders: the scalar and window vocabulary of the engine."""
