"""Operators for preparing training text at scale. Nothing else in cuemill imports this subpackage."""
