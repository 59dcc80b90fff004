"""morphotab.sources"""
