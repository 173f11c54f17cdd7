"""pageforge: landed web pages to clean, typed, queryable tables, as Spark jobs."""
