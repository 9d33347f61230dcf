"""sources of the quillon engine."""
