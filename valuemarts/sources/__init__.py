"""Staging table specs, CSV ingest, the test-data mapping and mart exports."""
