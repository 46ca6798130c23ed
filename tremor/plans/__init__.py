"""tremor.plans"""
