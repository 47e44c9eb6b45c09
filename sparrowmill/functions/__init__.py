"""sparrowmill.functions"""
