"""Encodings of sequencing-shaped tables onto other tables."""
