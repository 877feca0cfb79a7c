"""Streaming.

The library this package re-expresses is batch-only: it has no
watermark, window, stateful operator or late-data handling, and its
inputs are files read once.  Every operator here therefore works on
bounded DataFrames; to apply one to a stream, call it on each
micro-batch from ``foreachBatch`` (the operators are deterministic and
write through the DataFrame writer, so a replayed batch gives the same
result).  No streaming operator is provided on purpose.
"""
