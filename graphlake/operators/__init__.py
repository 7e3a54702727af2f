"""graphlake.operators"""
