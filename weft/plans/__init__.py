"""Compositions of operators: multi-step analyses as one lazy DataFrame."""
