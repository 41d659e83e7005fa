"""Operators on event logs, facts and shapes."""
