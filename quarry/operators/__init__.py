"""Relational, resolution, graph and mutation operators."""
