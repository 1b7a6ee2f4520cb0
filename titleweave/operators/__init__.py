"""titleweave.operators"""
