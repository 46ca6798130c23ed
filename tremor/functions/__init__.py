"""tremor.functions"""
