"""sparrowmill.operators"""
