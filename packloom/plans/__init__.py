"""Engine plans."""
