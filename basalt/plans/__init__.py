"""Named queries and their oracle SQL."""
