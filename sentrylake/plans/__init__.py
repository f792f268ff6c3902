"""Plans of the posture engine."""
