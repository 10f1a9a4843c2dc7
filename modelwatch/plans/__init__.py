"""modelwatch.plans"""
