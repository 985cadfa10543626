"""Relational operators over lines, characters, cells, pages and stored files."""
