"""Operators that prepare text corpora.  Nothing outside this folder imports it."""
