"""arborlight.functions"""
