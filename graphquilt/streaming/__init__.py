"""graphquilt.streaming"""
