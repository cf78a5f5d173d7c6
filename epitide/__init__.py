"""Diffusion and epidemic time-series analysis as Spark DataFrame jobs.

sources    readers and sinks for event logs, surveillance tables and keyed series
functions  column expressions: text cleaning, calendars, model terms
operators  DataFrame -> DataFrame steps: counts, state folds, fits, peaks, crossings
plans      whole jobs over all keys, and the registered queries
"""
