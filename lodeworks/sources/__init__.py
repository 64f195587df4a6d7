"""Readers, table projections and the versioned table store."""
