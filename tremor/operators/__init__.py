"""tremor.operators"""
