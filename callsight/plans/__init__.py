"""Whole reports: the metrics summary and the dashboard panels."""
