"""arborlight.operators"""
