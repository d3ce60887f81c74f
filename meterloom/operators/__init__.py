"""Operators on tables: meter-days, windows, weather, labels, models."""
