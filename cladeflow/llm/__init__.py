"""Operators on training data: survivors, clusters, samples, token ids, leaks and personal details."""
