"""modelwatch.sources"""
