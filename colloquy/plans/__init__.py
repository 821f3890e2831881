"""Plan helpers (distributed numbering, prefix sums) and the query catalog."""
