"""tremor.streaming"""
