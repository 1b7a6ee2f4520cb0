"""titleweave.sources"""
