"""markloom.functions"""
