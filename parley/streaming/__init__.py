"""parley.streaming"""
