"""Functions of the posture engine."""
