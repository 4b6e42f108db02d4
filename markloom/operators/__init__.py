"""markloom.operators"""
