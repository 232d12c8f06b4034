"""arborlight.streaming"""
