"""Query catalogue over the driver tables, and their oracle SQL."""
