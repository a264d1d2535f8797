"""Incremental voxel and segment aggregates over event streams."""
