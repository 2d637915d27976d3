"""graphquilt.operators"""
