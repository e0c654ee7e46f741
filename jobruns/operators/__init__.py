"""Operators over jobs, runs, edges, messages and samples."""
