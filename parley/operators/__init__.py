"""parley.operators"""
