"""A document catalog, search and corpus-preparation library made of Spark jobs."""
