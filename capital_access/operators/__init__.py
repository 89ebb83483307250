"""Table-level building blocks: joins, aggregates, reshaping, matching."""
