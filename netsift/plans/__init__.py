"""Query catalogue: the registered queries and their SQL twins."""
