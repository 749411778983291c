"""Query plans: each module offers QUERIES (name to callable) and SQL (name to oracle text)."""
