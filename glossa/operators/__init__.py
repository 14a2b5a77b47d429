"""Lookups and searches: functions from entries(dict, entry_no, key, value) to DataFrames."""
