"""linkscope.operators"""
