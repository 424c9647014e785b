"""Counts kept up to date as passages arrive."""
