"""linkscope.functions"""
