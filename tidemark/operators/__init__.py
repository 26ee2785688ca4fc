"""Relational operators over ordered tapes."""
