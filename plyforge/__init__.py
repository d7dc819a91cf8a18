"""plyforge: timeline analytics (games, events, any entity/step/state table) on Spark."""
