"""Column builders and fixed value tables shared by every job."""
