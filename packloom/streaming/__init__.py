"""Engine streaming."""
