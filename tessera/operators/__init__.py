"""DataFrame operators of the knowledge catalogue."""
