"""Plans over whole tables: the configurations, and the queries on the driver's tables."""
