"""Storage: segments with a manifest, and record file formats."""
