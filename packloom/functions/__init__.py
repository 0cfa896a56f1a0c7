"""Engine functions."""
