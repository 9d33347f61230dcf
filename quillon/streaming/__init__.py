"""streaming of the quillon engine."""
