"""Lang of the engine."""
