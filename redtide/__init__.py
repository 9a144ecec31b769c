"""Coastal bloom-matchup analytics as Spark DataFrame transforms."""
