"""graphquilt.functions"""
