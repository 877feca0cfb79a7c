"""Distributed operators: TSQR, stochastic SVD, recommender, top-n, text."""
