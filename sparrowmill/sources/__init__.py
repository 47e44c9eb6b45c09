"""sparrowmill.sources"""
