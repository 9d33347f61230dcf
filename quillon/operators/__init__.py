"""operators of the quillon engine."""
