"""morphotab.operators"""
