"""Views over the given tables, composite jobs and the registered queries."""
