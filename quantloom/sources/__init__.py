"""Scans, normalisers and sinks.  Everything becomes long DataFrames keyed by date and ticker."""
