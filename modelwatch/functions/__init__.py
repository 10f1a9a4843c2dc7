"""modelwatch.functions"""
