"""Part of gleanery; see the README."""
