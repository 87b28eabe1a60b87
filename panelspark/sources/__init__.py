"""Panels from fact tables, matrix files and candles; sinks for panels, series and side tables."""
