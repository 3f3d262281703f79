"""Scalar building blocks: byte predicates, hash keys, weight tables, paths, units."""
