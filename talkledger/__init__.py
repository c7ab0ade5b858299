"""Conversation compliance analytics on Spark DataFrames."""
