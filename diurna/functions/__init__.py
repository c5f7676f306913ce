"""Part of the signal analytics engine."""
