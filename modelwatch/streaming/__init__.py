"""modelwatch.streaming"""
