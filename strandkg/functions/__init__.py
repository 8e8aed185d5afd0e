"""Part of strandkg."""
