"""Readers: question and answer tables, JSON records, configuration."""
