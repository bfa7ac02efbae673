"""DataFrame operators of the four stages."""
