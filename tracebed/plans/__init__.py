"""Log views over tables, and the catalogue of queries."""
