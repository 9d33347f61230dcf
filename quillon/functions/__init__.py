"""functions of the quillon engine."""
