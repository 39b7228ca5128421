"""Live queries: results that follow the commits of a store."""
