"""graphlake.plans"""
