"""Spark jobs that turn noisy positioned text regions into clean counted inventories."""
