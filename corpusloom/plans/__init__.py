"""The query language: patterns, their compilation, and the planner."""
