"""Part of the engine; see README."""
