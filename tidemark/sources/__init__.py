"""Readers of tapes and audit tables."""
