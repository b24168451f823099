"""Operators of the log engine: derivation, rollups, projection, graph, sequences, flow."""
