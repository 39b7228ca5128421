"""Physical building blocks: scans, expansion, paths."""
