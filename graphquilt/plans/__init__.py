"""graphquilt.plans"""
