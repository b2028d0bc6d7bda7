"""Files that mappings are written to."""
