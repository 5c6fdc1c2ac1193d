"""linkscope.sources"""
