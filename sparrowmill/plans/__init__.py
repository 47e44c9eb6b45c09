"""sparrowmill.plans"""
