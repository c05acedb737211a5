"""Part of the loomline engine."""
