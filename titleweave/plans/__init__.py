"""titleweave.plans"""
