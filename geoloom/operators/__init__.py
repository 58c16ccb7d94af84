"""Operators on point and edge tables."""
