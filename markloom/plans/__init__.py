"""markloom.plans"""
