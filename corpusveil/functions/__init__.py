"""Part of the de-identification engine."""
