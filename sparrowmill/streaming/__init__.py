"""sparrowmill.streaming"""
