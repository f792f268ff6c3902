"""Sources of the posture engine."""
