"""End-to-end annotation jobs and the catalogue of checked queries."""
