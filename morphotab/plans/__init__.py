"""morphotab.plans"""
