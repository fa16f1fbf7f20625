"""Composed pipelines and the queries registered with the driver."""
