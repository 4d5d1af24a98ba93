"""Parameters and the engine that strings operators together."""
