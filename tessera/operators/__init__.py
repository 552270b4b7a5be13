"""Joins, orders, grids, statistics and sparse operators of point clouds."""
