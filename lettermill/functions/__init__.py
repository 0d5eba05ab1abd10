"""Column expressions: no function here runs a job or needs a shuffle."""
