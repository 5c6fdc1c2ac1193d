"""linkscope.plans"""
