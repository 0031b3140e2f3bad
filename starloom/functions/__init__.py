"""Part of the image analytics engine."""
