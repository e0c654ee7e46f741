"""The operators on streams.

Functions that take and return a DataFrame work on streaming and on batch frames. Functions named
``start_...`` run a query whose batches go through batch operators; each writes one folder per
batch, so a batch that is run again after a failure replaces its own output. They take trigger options such
as ``processingTime="30 seconds"``; without one they work off what there is and stop.
"""
