"""Plan building: cutting lineage, range joins, layered views and the query parser."""
