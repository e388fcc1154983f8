"""Operators over meter, session and bill tables; each takes and returns DataFrames."""
