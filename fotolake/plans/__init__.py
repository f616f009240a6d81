"""fotolake.plans"""
