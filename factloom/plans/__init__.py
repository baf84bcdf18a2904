"""Whole plans: from stored tables to answers."""
