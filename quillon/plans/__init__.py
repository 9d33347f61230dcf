"""plans of the quillon engine."""
