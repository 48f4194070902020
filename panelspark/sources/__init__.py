"""panelspark.sources"""
