"""Table operators: filters, gaps, joins, ordered walks, aggregates, reshape, spatial, images."""
