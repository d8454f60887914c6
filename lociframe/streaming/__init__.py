"""Per-locus operators over text streams."""
