"""titleweave.functions"""
