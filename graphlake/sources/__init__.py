"""graphlake.sources"""
