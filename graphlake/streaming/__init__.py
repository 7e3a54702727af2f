"""graphlake.streaming"""
