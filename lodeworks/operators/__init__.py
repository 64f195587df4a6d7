"""Relational, graph and data-cleaning operators; every one takes and returns DataFrames."""
