"""Incremental operation on file streams (an extension; the batch operators do not need it)."""
