"""linkscope.streaming"""
