"""Ledger analytics as Spark DataFrame jobs.

Functions take and return DataFrames (or Columns); nothing runs until the
caller writes or collects the result.
"""
