"""Operators for training text. Nothing else in strandkg imports this subpackage."""
