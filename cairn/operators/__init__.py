"""Relational operators on change logs and documents."""
