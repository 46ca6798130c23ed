"""tremor.sources"""
