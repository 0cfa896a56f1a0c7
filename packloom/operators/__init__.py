"""Engine operators."""
