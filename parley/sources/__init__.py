"""parley.sources"""
