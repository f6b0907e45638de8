"""DataFrame -> DataFrame operators: normalisation, filters, joins,
aggregations, dedup, ordering and paging, page and payload extraction."""
