"""Readers and writers of points, exact densities, neighbour lists and configurations."""
