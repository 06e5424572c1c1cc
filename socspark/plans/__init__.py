"""Configuration, schemas and composed jobs."""
