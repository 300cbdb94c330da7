"""Relational operators over reads, variants, intervals and counts; every one takes and returns DataFrames or Columns."""
