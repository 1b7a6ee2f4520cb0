"""titleweave.streaming"""
