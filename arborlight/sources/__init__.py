"""arborlight.sources"""
