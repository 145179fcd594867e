"""Jobs: the registered queries."""
