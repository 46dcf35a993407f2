"""Relational building blocks: cleaning, predicates, joins, aggregates, reshapes."""
