"""Compositions of operators into whole batch jobs."""
