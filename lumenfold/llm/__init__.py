"""Operators of a training-data pipeline: one module per operator.

Nothing outside this package imports it.  Every operator reads only the columns it names, so extra columns
never clash, and every operator is a plan over the whole input: there are no row caps, prefixes or samples
besides the documented bounds on what a model is fitted on.
"""
