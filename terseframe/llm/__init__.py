"""Training-data operators: readers, scorers, samplers, joins and scrubbers.

Nothing else in the library imports this package.
"""
