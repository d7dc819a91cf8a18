"""Rules of the engine."""
