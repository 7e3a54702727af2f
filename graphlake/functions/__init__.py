"""graphlake.functions"""
