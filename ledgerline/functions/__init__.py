"""Column functions with the engine's semantics, and text matching for lookups."""
