"""Operators on point, graph, voxel and sparse-tensor tables."""
