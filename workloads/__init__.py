"""Checked workloads: every operator run over the test tables, and the same in SQL."""
