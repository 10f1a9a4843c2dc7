"""modelwatch.operators"""
